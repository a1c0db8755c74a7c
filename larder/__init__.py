"""Daily demand, forecasting and perishable-stock analytics on Spark.

Every table is keyed by ``(series_id, date)``: one series is one product at one
site.  Functions take and return DataFrames; nothing is computed until the
caller acts, except where a model has to be fitted (``plans.selection`` and
``plans.tuned``).
"""
