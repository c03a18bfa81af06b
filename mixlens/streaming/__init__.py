"""No streaming operators, on purpose.

The workload is batch: every input is a one-shot load, and its series
operators are row-count windows (adstock, right-aligned and centred means,
lag, interpolation) that Structured Streaming rejects on streaming frames
(``NON_TIME_WINDOW_NOT_SUPPORTED_IN_STREAMING``).  Fitting, segmentation and
scoring all read whole, finished tables.  New data is handled by re-running
the batch plans over the grown tables; nothing is kept here.
"""
