"""Meta-analysis: distributions, pooling models, bias tests, diagnostics."""
