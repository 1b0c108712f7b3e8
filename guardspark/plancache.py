"""Built plan expressions, kept per running SparkContext.

Building a plan crosses into the JVM once per expression node, so a chain of
guards takes longer to build than to analyse; expressions are pure functions of
their settings and can be reused.  Entries go with their SparkContext (a weak
reference), and only the ``LIMIT`` last used are kept.  Keys must not hold
secrets: pass ``fingerprint(secret)``.
"""

from __future__ import annotations

import hashlib
import weakref
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any

LIMIT = 256

_CACHES: weakref.WeakKeyDictionary[Any, OrderedDict[Hashable, Any]] = weakref.WeakKeyDictionary()


def fingerprint(secret: str) -> str:
    return hashlib.sha256(b"plan-key\x00" + secret.encode()).hexdigest()


def cached(key: Hashable, build: Callable[[], Any]) -> Any:
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is None:
        return build()
    entries = _CACHES.setdefault(context, OrderedDict())
    if key in entries:
        entries.move_to_end(key)
    else:
        entries[key] = build()
        if len(entries) > LIMIT:
            entries.popitem(last=False)
    return entries[key]
