"""Phrases found from places: an index of where each piece of a text stands, and a merge of places.

A piece is what stands between two blanks of a text. A pattern of several pieces is contained in a text exactly where, at neighbouring places,
one piece ends with its first piece, the following ones equal its inner pieces and the last one begins with its last piece. So once texts
are indexed, any batch of patterns is answered without reading them: asked pieces meet the vocabulary, each pattern starts from
the places of its rarest piece, and the places of the others confirm or refuse these, the next rarest first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import broadcast_if_small, checkpointed, spread, stored

#: Places of a block. A posting holds places of one block as offsets from its beginning, so no posting is longer, whatever the text.
BLOCK = 1024
#: Rows of asked words or pieces, each of two short strings and some numbers, that may be broadcast.
ASKED = 200_000


def _hinted(df: DataFrame) -> DataFrame:
    return broadcast_if_small(df, ASKED)


@dataclass
class Places:
    """postings(piece, id, block, at: offsets in the block), vocabulary(piece, n: places)."""

    postings: DataFrame
    vocabulary: DataFrame

    def persist(self, path: str) -> Places:
        """The index written as tables, postings in order of pieces, so that asked pieces prune files; a frequent piece spreads by id."""
        self.postings.repartitionByRange("piece", "id").sortWithinPartitions("piece", "id").write.mode("overwrite").parquet(f"{path}/postings")
        read = self.postings.sparkSession.read
        postings = read.parquet(f"{path}/postings")
        _vocabulary(postings).write.mode("overwrite").parquet(f"{path}/vocabulary")
        return Places(postings, read.parquet(f"{path}/vocabulary"))


def _vocabulary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("piece").agg(F.sum(F.size("at")).alias("n"))


def placed(texts: DataFrame, key: str, column: str, keep: bool = False) -> Places:
    """The index of ``column``, a text for each ``key`` (unique; rows without one are never found). Null counts as empty.

    ``keep``: postings and vocabulary are written once as tables in the shared folder, for a plan that reads them several times.
    """
    rows = spread(texts.select(F.col(key).alias("id"), F.coalesce(F.col(column), F.lit("")).alias("_t")).filter("id is not null"), "id")
    own = rows.select("id", F.posexplode(F.split("_t", " ")).alias("pos", "piece"))
    block = F.floor(F.col("pos") / BLOCK).cast("int").alias("block")
    postings = own.groupBy("piece", "id", block).agg(F.sort_array(F.collect_list((F.col("pos") % BLOCK).cast("short"))).alias("at"))
    if not keep:
        return Places(postings, _vocabulary(postings))
    postings = stored(postings)
    return Places(postings, stored(_vocabulary(postings)))


def containing(places: Places, word: str) -> DataFrame:
    """(id): texts that contain ``word``, which has no blank."""
    if not word or " " in word:
        raise ValueError("one word without blanks is looked up")
    pieces = places.vocabulary.filter(F.contains("piece", F.lit(word))).select("piece")
    return places.postings.join(_hinted(pieces), "piece", "left_semi").select("id").distinct()


def _cut(lengths: list[int], role: str, cut) -> Column:
    """The ends of a piece of the asked lengths, however long the piece."""
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("piece"))
    return F.transform(fitting, lambda n: F.struct(F.lit(role).alias("role"), cut(F.col("piece"), n).alias("word")))


def _known(vocabulary: DataFrame, words: DataFrame, first: list[int], last: list[int]) -> DataFrame:
    """(role, word, piece, n): the pieces of the vocabulary that can stand for an asked word in its role."""
    same = F.array(F.struct(F.lit("inner").alias("role"), F.col("piece").alias("word")))
    roles = F.concat(same, _cut(first, "first", F.right), _cut(last, "last", F.left))
    asked = words.select("role", "word").distinct()
    return vocabulary.select("piece", "n", F.explode(roles).alias("r")).select("r.role", "r.word", "piece", "n").join(_hinted(asked), ["role", "word"])


def _confirmed(found: DataFrame, words: DataFrame, known: DataFrame, places: Places) -> DataFrame:
    """The rows of ``found`` (pattern, id, start) at which all of ``words`` stand; patterns without such words stay."""
    count = words.groupBy("pattern").agg(F.count("*").alias("k"))
    wanted = found.join(_hinted(words.select("pattern", "nth", "role", "word")), "pattern").withColumn("pos", F.col("start") + F.col("nth"))
    pieces = known.join(_hinted(words.select("role", "word").distinct()), ["role", "word"], "left_semi").select("piece").distinct()
    where = wanted.select("id", F.floor(F.col("pos") / BLOCK).cast("int").alias("block")).distinct()
    near = places.postings.join(_hinted(pieces), "piece", "left_semi").join(_hinted(where), ["id", "block"], "left_semi")
    near = near.select("id", "piece", "block", F.explode("at").alias("_at")).select("id", "piece", (F.col("block") * BLOCK + F.col("_at")).alias("pos"))
    fits = F.when(F.col("role") == "first", F.endswith("piece", "word")).when(F.col("role") == "last", F.startswith("piece", "word")).otherwise(F.col("piece") == F.col("word"))
    right = wanted.join(near, ["id", "pos"]).filter(fits).groupBy("pattern", "id", "start").agg(F.count("*").alias("n"))
    right = right.join(_hinted(count), "pattern").filter("n = k").select("pattern", "id", "start")
    return found.join(_hinted(count), "pattern", "left_anti").unionByName(right)


def occurrences(places: Places, patterns: DataFrame) -> DataFrame:
    """(id, pattern): every text with each of the ``patterns`` (pattern) that it contains, once.

    Null and empty patterns occur nowhere; one without a blank is an error (see ``containing``). Three joins find patterns of any length.
    """
    pieces = F.split("pattern", " ")
    # Places are merged under numbers; the patterns' texts come back with the results.
    asked = checkpointed(patterns.filter("pattern <> ''").select("pattern").distinct().withColumn("_n", F.monotonically_increasing_id()))
    words = asked.select(F.col("_n").alias("pattern"), F.size(pieces).alias("k"), F.posexplode(pieces).alias("nth", "word"))
    role = F.when(F.col("nth") == 0, "first").when(F.col("nth") == F.col("k") - 1, "last").otherwise("inner")
    words = checkpointed(words.withColumn("role", role))
    # Distinct lengths are few: n of them take patterns of n * n / 2 characters together.
    of = lambda role: F.collect_set(F.when(F.col("role") == role, F.length("word")))
    facts = words.agg(F.min("k").alias("least"), of("first").alias("first"), of("last").alias("last")).head()
    if facts["least"] == 1:
        raise ValueError("patterns of one piece are looked up by containing()")
    known = checkpointed(_known(places.vocabulary, words, facts["first"], facts["last"]))
    often = known.groupBy("role", "word").agg(F.sum("n").alias("n"))
    of_pattern = Window.partitionBy("pattern")
    ranked = words.join(_hinted(often), ["role", "word"], "left").withColumn("turn", F.row_number().over(of_pattern.orderBy(F.asc_nulls_first("n"), "nth")))
    ranked = checkpointed(ranked.withColumn("all", F.min(F.col("n").isNotNull()).over(of_pattern)).filter("all").select("pattern", "nth", "role", "word", "turn"))
    rarest = ranked.filter("turn = 1").join(known, ["role", "word"]).select("piece", "pattern", "nth")
    found = places.postings.join(_hinted(rarest), "piece").select("pattern", "id", "nth", "block", F.explode("at").alias("_at"))
    found = checkpointed(found.select("pattern", "id", (F.col("block") * BLOCK + F.col("_at") - F.col("nth")).alias("start")).filter("start >= 0"))
    found = checkpointed(_confirmed(found, ranked.filter("turn = 2"), known, places))
    if not ranked.filter("turn > 2").isEmpty():
        found = _confirmed(found, ranked.filter("turn > 2"), known, places)
    return found.select("id", F.col("pattern").alias("_n")).distinct().join(_hinted(asked), "_n").select("id", "pattern")
