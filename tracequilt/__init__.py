"""tracequilt: network-traffic analytics as Spark DataFrame operators.

Frames -> packets -> rollup -> flows / sessions / hosts / services / ticks,
then enrichment, filters, detectors and export.  Every operator is a function
from DataFrame to DataFrame or returns a Column; all of them key on
``capture_id`` so that many captures run in one job.
"""

__version__ = "0.1.0"
