"""barweave: time-series and cross-section analytics over long bar panels, on PySpark.

Every operator is a function from DataFrame(s) to DataFrame.  A panel is *long*:
one row per ``(ticker, date)``.  Two physical facts follow and the whole library
leans on them:

* a per-ticker window holds at most one row per calendar day, so it is bounded
  by the calendar and never by the size of the raw data;
* a per-date group holds as many rows as there are tickers, which is *not*
  bounded, so cross-section work uses map-side combined aggregates and the
  value-range ranking of :mod:`barweave.functions.ranks`, never a bare window
  over a date.
"""
