"""spineworks: subscription analytics on Spark.

Loads account, subscription, feature-usage, support-ticket and churn-event
tables, profiles and cleans them, and computes monthly metrics over a
calendar spine. Every public function takes DataFrames plus explicit
parameters and returns a lazy DataFrame; nothing is collected to the driver.
"""

from spineworks.plans.params import Params  # noqa: F401

__all__ = ["Params"]
