"""hitframe: detector hit analytics as DataFrame-to-DataFrame functions on Spark.

Two working forms share one set of semantics:

* long form, one row per hit (``hits``), for tables that already hold hits as rows;
* nested form, one row per event with a hit array per side (``events``), which is what the event-file
  sources emit and which needs no shuffle for any per-event feature.
"""
