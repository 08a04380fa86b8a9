"""packwright: Spark-native preparation of language-model training rows.

Every operator is a DataFrame -> DataFrame (or Column -> Column) function built from
Spark SQL expressions, windows, joins and aggregations, so Catalyst plans it and the
work is partitioned across the cluster.
"""

from packwright.params import Params

__all__ = ["Params"]
