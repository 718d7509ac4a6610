"""What is shared: the folder of driver and executors, and the results that a worker keeps for later texts."""

from __future__ import annotations

import os
import re
import tempfile
from functools import lru_cache, wraps

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session without it gets an own folder; a cluster must name one."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "gistmill-checkpoints")


#: Results of so many texts, of so many characters at most, are kept in a worker.
KEPT, KEPT_CHARS = 1 << 14, 256


def kept(f):
    """A pure function whose results for short texts are kept, as lines and sentences often stand in many documents."""
    known = lru_cache(KEPT)(f)

    @wraps(f)
    def call(text, *args, **named):
        out = (known if len(text) <= KEPT_CHARS else f)(text, *args, **named)
        # callers own lists
        return [*out] if isinstance(out, list) else (out[0], [*out[1]]) if isinstance(out, tuple) else out

    return call
