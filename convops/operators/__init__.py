"""Set-at-a-time building blocks shared by the reports, rule jobs and audits.

* ``lookups``  — existence flags and key lookups (left joins against key sets; semi/anti joins for filters)
* ``decide``   — ordered rejection reasons, the accepted/rejected split and the decision frame
* ``dedup``    — first / last request per key with partial aggregation (hot keys collapse map-side)
* ``ranking``  — running rank within a group that splits hot groups into time buckets
* ``ids``      — dense new surrogate ids in a global order, without funnelling rows through one task
* ``claims``   — who gets a unique value, request by request, in rounds
"""
