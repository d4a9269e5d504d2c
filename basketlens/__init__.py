"""basketlens: customer and web analytics as Spark DataFrame operators.

Every analysis is a pure function ``DataFrame -> DataFrame`` built from
built-in Spark SQL expressions, so Catalyst plans it and whole-stage
codegen runs it; nothing is collected to the driver inside an operator.

Sub-packages:

* ``sources``    canonical frames (order log, clients, transactions, daily
                 traffic, channel tables), CSV ingest with quarantine,
                 partitioned snapshot sink/reader
* ``functions``  column-expression helpers: parsing, score bands, profiles,
                 rounding, calendar labels
* ``operators``  the analyses (KPIs, churn, RF/RFM segmentation, cohorts,
                 snapshots, clients, traffic and channels)
* ``plans``      session settings, broadcast bounds, the query catalog
* ``streaming``  incremental daily traffic from an event stream
"""

from basketlens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
