"""Training-data operators: ten stages of a text / vector corpus pipeline.

Nothing outside this package imports it. On a cluster the package has to be
importable on the executors (``--py-files`` or a common install), because the
operators that are not purely SQL run their per-batch functions there.
"""
