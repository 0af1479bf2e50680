"""Allow lists: dictionary parsing and the anti join of spans with their terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.operators.candidates import allow_key

#: Terms up to this many bytes by Spark's estimate are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """lines(position, value) -> term, position: the main term before ``/alias[`` or
    ``/js[`` and the aliases between ``|``, each once at its first position."""
    line = F.trim("value")
    main = F.trim(F.regexp_extract(line, r"^(.*?)(?:/alias\[|/js\[|$)", 1))
    aliases = F.regexp_extract(line, r"/alias\[([^\]]*)\]", 1)
    terms = F.concat(F.array(main), F.transform(F.split(aliases, r"\|"), lambda x: F.trim(x)))
    rows = lines.where(line != "").select("position", F.posexplode(terms).alias("nth", "term")).where("term <> ''")
    first = rows.groupBy("term").agg(F.min(F.struct("position", "nth")).alias("at"))
    return first.select("term", F.col("at.position").alias("position"), F.col("at.nth").alias("nth"))


def drop_allowed(spans: DataFrame, terms: DataFrame, folded: bool = True) -> DataFrame:
    """Span rows whose text is no allowed term (``folded``: lower case, without spaces)."""
    key = allow_key if folded else (lambda c: c)
    keys = terms.select(key(F.col("term")).alias("allowed")).distinct()
    size = int(str(keys._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    return spans.join(keys, key(F.col("text")) == F.col("allowed"), "left_anti")
