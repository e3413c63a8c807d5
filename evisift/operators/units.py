"""Problem 3: quantities recorded in different units, converted to common ones.

Every row gives the spelling of its unit: from the unit column, else from the text
as entered, else from the place it was found in. Only the *distinct* spellings are
mapped: the registry's names and their short forms are cut into character n-grams
in an inverted index; a spelling meets the names that share n-grams with it, and
a weighted edit distance decides. The resulting alias dictionary is joined to all
rows. The dictionary has a row a distinct spelling, so the join is an ordinary one:
Spark broadcasts it while it is below its own limit, and splits hot spellings beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.functions.quantities import NUMBER, SCALE, digits_for_words, number_value, plain_scale, plain_text, scale_value, unit_words
from evisift.plans.lineage import Workspace

# Usual short forms of units (SI brochure, clinical usage).
SHORT_FORMS = {
    "milliseconds": "ms msec msecs", "seconds": "s sec secs", "minutes": "min mins", "hours": "h hr hrs", "days": "d", "weeks": "w wk wks",
    "months": "mo mos mth mths", "years": "y yr yrs a", "micrograms": "ug mcg mcgs", "milligrams": "mg mgs", "grams": "g gm gms gr",
    "kilograms": "kg kgs kilo kilos", "ounces": "oz ozs", "pounds": "lb lbs", "micrometres": "um micron microns", "millimetres": "mm",
    "centimetres": "cm cms", "metres": "m mtr", "kilometres": "km kms", "inches": "in ins", "feet": "ft foot", "yards": "yd yds", "miles": "mi",
}

# Words around a quantity that change nothing about it.
LEADS = r"^(?:reported as|about|approximately|mean|approx\.?|ca\.?|n ?=|~|≈)\s*"
TAILS = r"\s*(?:\([^)]*\)|, per protocol)$"

NGRAM = 3
#: Least weighted similarity of a spelling to a name, and least length of a spelling to be read fuzzily.
SIMILAR = 0.8
LENGTH = 5


def registry_spellings(registry: DataFrame) -> DataFrame:
    """``(alias, unit)``: names of the registry, singular and American forms, short forms, with ``/`` for *per*."""

    def forms(name: str) -> set[str]:
        base = {name}
        if name.endswith("ches"):
            base.add(name[:-2])
        elif name.endswith("s"):
            base.add(name[:-1])
        base |= {b.replace("metre", "meter") for b in base} | {b.replace("gram", "gramme") for b in base if "gram" in b}
        return base | set(SHORT_FORMS.get(name, "").split())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for unit in pdf["unit"].dropna():
                over, _, under = unit.strip().lower().partition(" per ")
                lower = forms(under) | forms(under + "s") if under else {""}
                out += [(f"{a}/{b}" if b else a, unit) for a in forms(over) for b in lower]
            yield pd.DataFrame(out, columns=["alias", "unit"])

    return registry.select("unit").mapInPandas(run, "alias string, unit string").distinct()


def weighted_distance(a: str, b: str) -> float:
    """Edit distance in which swaps of neighbours cost 0.7, vowels for vowels 0.6, doubled or final letters 0.5, all else 1."""
    soft = set("aeiouy")
    rows = [[j * 1.0 for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [i * 1.0]
        for j, y in enumerate(b, 1):
            change = 0.0 if x == y else 0.6 if x in soft and y in soft else 1.0
            lose = 0.5 if i > 1 and a[i - 2] == x or i == len(a) and x in "s." else 1.0
            gain = 0.5 if j > 1 and b[j - 2] == y or j == len(b) and y == "s" else 1.0
            best = min(rows[i - 1][j - 1] + change, rows[i - 1][j] + lose, row[j - 1] + gain)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, rows[i - 2][j - 2] + 0.7)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def alias_dictionary(spellings: DataFrame, registry: DataFrame) -> DataFrame:
    """``(spelling, unit)`` of the distinct ``spellings`` that name a unit of the registry; others have no row.

    An exact form wins; otherwise the nearest name with similarity ``SIMILAR`` or more among those sharing an n-gram,
    and none if two units are equally near.
    """
    names = registry_spellings(registry)
    exact = spellings.join(names, spellings["spelling"] == names["alias"]).select("spelling", "unit")
    rest = spellings.join(names, spellings["spelling"] == names["alias"], "left_anti").where(F.length("spelling") >= LENGTH)

    def grams(c: str):
        padded = F.concat(F.lit("^"), F.col(c), F.lit("$"))
        return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (NGRAM - 1)), lambda i: F.substring(padded, i, F.lit(NGRAM)))))

    index = names.where(F.length("alias") >= LENGTH - 1).select("alias", "unit", grams("alias").alias("gram"))
    # one shared gram is enough: swapped letters leave a short name no more than one
    met = rest.select("spelling", grams("spelling").alias("gram")).join(index, "gram").select("spelling", "alias", "unit").distinct()

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1 - weighted_distance(x, y) / max(len(x), len(y)) for x, y in zip(a, b)], dtype="float64")

    near = met.withColumn("sim", similarity("spelling", "alias")).where(F.col("sim") >= SIMILAR)
    near = near.groupBy("spelling", "unit").agg(F.max("sim").alias("sim")).groupBy("spelling").agg(
        F.max_by("unit", "sim").alias("unit"), F.max("sim").alias("top"), F.sort_array(F.collect_list("sim"), False).alias("sims")
    )
    fuzzy = near.where((F.size("sims") == 1) | (F.get("sims", F.lit(1)) < F.col("top"))).select("spelling", "unit")
    return exact.unionByName(fuzzy)


def read_quantities(values: DataFrame) -> DataFrame:
    """Add ``amount_1, spelling_1, amount_2, spelling_2`` (a compound such as ``5 ft 9 in`` has two parts) to ``values``.

    Needs value, unit, entered, source. Amounts include multipliers such as ``x1000`` of the unit. What cannot be read is null.
    """
    d = values.select("*", plain_text(F.col("entered")).alias("_e0"), plain_text(F.col("unit")).alias("_u"), plain_text(F.col("source")).alias("_p"))
    d = d.withColumn("_e1", F.regexp_replace("_e0", LEADS + "|" + TAILS, ""))
    d = d.withColumn("_e", F.coalesce(digits_for_words(F.col("_e1")), F.lit("")))
    two = rf"^({NUMBER})\s*(?!e[+-]?\d)([a-z]+\.?)\s*(?:,|and|&)?\s*({NUMBER})\s*([a-z]+\.?)$"
    one = rf"^({NUMBER})\s*(.*)$"
    found = F.regexp_extract("_p", r"(?:values (?:are )?in |column head '|measured in |\bunits?: ?)([^')]+)", 1)
    d = d.withColumn("_said", F.coalesce(F.nullif("_u", F.lit("")), F.nullif(F.regexp_extract("_e", one, 2), F.lit("")), F.nullif(found, F.lit(""))))
    d = d.withColumn("_x", plain_scale(F.regexp_extract("_said", rf"^({SCALE})\s+\S", 1))).withColumn("_w", F.regexp_replace("_said", rf"^{SCALE}\s+(?=\S)", ""))
    d = d.withColumn("_first", F.coalesce(F.when(~F.isnan("value"), F.col("value")), number_value(F.regexp_extract("_e", one, 1))))
    d = d.withColumn("_two", F.col("value").isNull() & F.col("unit").isNull() & F.col("_e").rlike(two))
    return d.select(
        *values.columns,
        F.when(F.col("_two"), number_value(F.regexp_extract("_e", two, 1))).otherwise(F.col("_first") * scale_value(F.col("_x"))).alias("amount_1"),
        unit_words(F.when(F.col("_two"), F.regexp_extract("_e", two, 2)).otherwise(F.col("_w"))).alias("spelling_1"),
        F.when(F.col("_two"), number_value(F.regexp_extract("_e", two, 3))).alias("amount_2"),
        F.when(F.col("_two"), unit_words(F.regexp_extract("_e", two, 4))).alias("spelling_2"),
    )


def convert_quantities(values: DataFrame, form: DataFrame, registry: DataFrame) -> DataFrame:
    """``(value_id, unit, value_milli)``: each reported quantity in the unit of its form field, times 1000, rounded half up.

    No row for: not reported, a null value_id, no number, no unit or one the registry does not know, a unit of another
    dimension, a field without a unit. Repeated rows of a value_id count once; if they differ, the last entered one counts
    (ties: the larger result). Both parts of a compound need a known unit of the dimension.
    """
    v = values.where("value_id is not null and not coalesce(not_reported, false)").select("value_id", "field", "value", "unit", "entered", "source", "entered_at")
    fields = form.where("unit is not null").groupBy("field").agg(F.min("unit").alias("to_unit"))
    read = read_quantities(v.join(F.broadcast(fields), "field")).select("value_id", "to_unit", "entered_at", "amount_1", "spelling_1", "amount_2", "spelling_2")
    # read twice below; written before any filter, which would be pushed into the regular expressions and repeat them
    parts = Workspace(values.sparkSession, "units").write(read, "parts").where("amount_1 is not null and spelling_1 <> ''")
    spellings = parts.select(F.explode(F.array("spelling_1", "spelling_2")).alias("spelling")).where("spelling <> ''").distinct()
    size = registry.select("unit", "dimension", "factor")
    known = alias_dictionary(spellings, registry).join(F.broadcast(size), "unit").select("spelling", "dimension", "factor")
    a = known.select(F.col("spelling").alias("spelling_1"), F.col("dimension").alias("d1"), F.col("factor").alias("f1"))
    b = known.select(F.col("spelling").alias("spelling_2"), F.col("dimension").alias("d2"), F.col("factor").alias("f2"))
    to = F.broadcast(size.select(F.col("unit").alias("to_unit"), F.col("dimension").alias("dt"), F.col("factor").alias("ft")))
    j = parts.join(a, "spelling_1").join(b, "spelling_2", "left").join(to, "to_unit").where("d1 = dt and (spelling_2 is null or (d2 = dt and amount_2 is not null))")
    base = F.col("amount_1") * F.col("f1") + F.coalesce(F.col("amount_2") * F.col("f2"), F.lit(0.0))
    milli = base / F.col("ft") * 1000
    # a tie in decimal figures may lie just below the half in binary ones
    j = j.withColumn("value_milli", F.floor(milli + F.lit(0.5) + F.abs(milli) * F.lit(1e-12)).cast("bigint"))
    return j.groupBy("value_id").agg(F.max(F.struct("entered_at", "value_milli", "to_unit")).alias("r")).select("value_id", F.col("r.to_unit").alias("unit"), F.col("r.value_milli").alias("value_milli"))
