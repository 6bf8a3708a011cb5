"""flowlure: honeypot-strategy analytics over network flows, written as Spark DataFrame jobs.

Layout
------
functions/  column expressions (state classes, time parsing, keyed rolls, placement rules)
sources/    readers and writers (flow archive, strategy NDJSON, statistics documents,
            flows derived from the ``events`` test table)
operators/  DataFrame -> DataFrame operators (attackers, port probabilities, replay, game)
plans/      end-to-end jobs, the query catalogue and its SQL oracle
streaming/  the daily statistics job run incrementally over a growing flow archive
"""

from flowlure import config

__all__ = ["config"]
