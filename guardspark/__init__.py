"""guardspark: text-screening guards as Spark column expressions.

Entry points:

* ``guardspark.plans.chain``    - input / output guard chains (E1, E2)
* ``guardspark.plans.verdict``  - request verdicts (E4, E5)
* ``guardspark.operators.vault`` - reversible tokenization (D1-D4)
* ``guardspark.operators.audit`` - guard events and rollups (F1-F4)
* ``guardspark.streaming.stream`` - streaming screens and windows (H1, H2)
* ``guardspark.policy``         - shipped policy and overlays
"""

__all__ = ["policy", "session"]
