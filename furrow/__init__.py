"""furrow: Spark-native field-data analytics.

Composable ``DataFrame -> DataFrame`` operators and ``Column -> Column``
functions for profiling, cleaning, generating, encoding, evaluating,
scoring, explaining, retrieving and routing agricultural field data and
advisory text. Everything runs as Spark SQL / DataFrame plans.
"""

__version__ = "0.1.0"
