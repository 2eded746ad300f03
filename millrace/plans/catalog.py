"""All registered queries of the library, by importing every module that registers some."""

from millrace.operators import columnar, commit, control, delivery, exchange, integrity, push, read, slots  # noqa: F401
from millrace.plans import api, relational  # noqa: F401
from millrace.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
from millrace.streaming import jobs  # noqa: F401
