"""loadcast: quarter-hour load forecasting as Spark DataFrame plans.

Every public operator is a ``DataFrame -> DataFrame`` function (or a
fit) whose work is planned by Catalyst and executed by Spark; nothing in the
library pulls a data-sized frame to the driver.

Sub-packages
------------
sources    reading the fact and the lookup tables
functions  column expressions: clocks, slot arithmetic, null guards
operators  series, windows, enrichment, profiles, clustering, models, audits
plans      end-to-end forecasters and the registry of checkable queries
"""

__version__ = "0.1.0"
