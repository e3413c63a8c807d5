"""evisift subpackage."""
