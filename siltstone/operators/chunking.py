"""Chunkers and the pipeline that splits long documents into chunks."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import estimate_tokens


class Tokenizer(Protocol):
    """counts and windows work on array<string> Columns, so that a document's parts go through one call."""

    def encode(self, text: str) -> list: ...
    def decode(self, tokens: list) -> str: ...
    def counts(self, texts: Column) -> Column: ...
    def windows(self, texts: Column, size: int, overlap: int) -> Column: ...


class WordTokenizer:
    """Blank-separated words; needs no vocabulary, so the SQL oracle can count the same."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, tokens: list[str]) -> str:
        return " ".join(tokens)

    def counts(self, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")))

    def windows(self, texts: Column, size: int, overlap: int) -> Column:
        return F.transform(texts, lambda t: word_windows(t, size, overlap))


class BpeTokenizer:
    """A public byte-level BPE from a vocabulary file of ranks; loaded once a worker."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self._enc = path, pattern, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern, "_enc": None}

    def _load(self):
        if self._enc is None:
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._enc = tiktoken.Encoding("chunker", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._enc

    def encode(self, text: str) -> list[int]:
        return self._load().encode_ordinary(text)

    def decode(self, tokens: list[int]) -> str:
        """A character cut by a window's edge is left to the window that holds all of it."""
        return self._load().decode_bytes(tokens).decode("utf-8", "ignore")

    def counts(self, texts: Column) -> Column:
        @F.pandas_udf("array<int>")
        def run(col: pd.Series) -> pd.Series:
            return col.map(lambda ts: None if ts is None else [len(self.encode(t)) for t in ts])

        return run(texts)

    def windows(self, texts: Column, size: int, overlap: int) -> Column:
        @F.pandas_udf("array<array<string>>")
        def run(col: pd.Series) -> pd.Series:
            return col.map(lambda ts: None if ts is None else [windows(t, size, overlap, self) for t in ts])

        return run(texts)


def window_starts(n: int, size: int, overlap: int) -> list[int]:
    """Starts of windows of `size` tokens that share `overlap`; the last one reaches the end."""
    if n == 0:
        return []
    step = size - min(overlap, size - 1)
    return list(range(0, max(1, n - size + step), step)) if n > size else [0]


def windows(text: str, size: int, overlap: int, tok: Tokenizer) -> list[str]:
    t = tok.encode(text)
    if not t:
        return []
    return [text] if len(t) <= size else [tok.decode(t[s : s + size]) for s in window_starts(len(t), size, overlap)]


def word_windows(content: Column, size: int, overlap: int) -> Column:
    """array<string> of windows over blank-separated words, as one expression: strings are built before any explode."""
    t = F.filter(F.split(content, r"\s+"), lambda w: w != "")
    step = size - min(overlap, size - 1)
    last = F.greatest(F.size(t) - size + step - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(step))
    cut = F.transform(starts, lambda s: F.array_join(F.slice(t, s + 1, size), " "))
    return F.when(F.size(t) == 0, F.array().cast("array<string>")).when(F.size(t) <= size, F.array(F.array_join(t, " "))).otherwise(cut)


def chunk_windows(docs: DataFrame, size: int = 128, overlap: int = 16, key: str = "id", content: str = "content") -> DataFrame:
    """(id, chunk_index, chunk)."""
    return docs.select(F.col(key).alias("id"), F.posexplode(word_windows(F.col(content), size, overlap)).alias("chunk_index", "chunk"))


def byte_slices(text: str, size: int) -> list[str]:
    """Slices of about 4 * size bytes that end on whole characters."""
    raw, out, at = text.encode(), [], 0
    while at < len(raw):
        end = min(len(raw), at + 4 * size)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        out.append(raw[at:end].decode())
        at = end
    return out


#: A line of three or more of one sign; the text gets a line break in front, so every line begins with one.
_RULE = r"(?U)\n[^\S\n]*(?:-{3,}|_{3,}|\*{3,})[^\S\n]*(?=\n|$)"
MARKDOWN_OVERLAP = 50


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def markdown_sections(content: Column) -> Column:
    """array<string>: what stands between rule lines, trimmed; blank lines between two rules give an empty string, no line gives nothing."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), content), _RULE, -1), lambda p: p != "")
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.transform(parts, _stripped))


def _packs(counts: Column, section: Column, size: int) -> Column:
    """Runs of paragraphs: array of (at, len, n, wide, again).

    A run keeps to its section and to `size` tokens in all. wide: one paragraph above `size`. again: the run began because the
    one before it was full."""
    kind = "array<struct<at:int,len:int,n:int,wide:boolean,again:boolean>>"

    def step(runs: Column, i: Column) -> Column:
        n, last = F.get(counts, i), F.try_element_at(runs, F.lit(-1))
        open_ = F.coalesce(~last["wide"] & (F.get(section, i) == F.get(section, last["at"])), F.lit(False))
        wide = n > size
        grown = F.struct(last["at"].alias("at"), (last["len"] + 1).alias("len"), (last["n"] + n).alias("n"), F.lit(False).alias("wide"), last["again"].alias("again"))
        begun = F.struct(i.alias("at"), F.lit(1).alias("len"), n.alias("n"), wide.alias("wide"), (open_ & ~wide).alias("again"))
        joins = open_ & ~wide & (last["n"] + n <= size)
        return F.when(joins, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(grown))).otherwise(F.concat(runs, F.array(begun))).cast(kind)

    return F.aggregate(F.sequence(F.lit(0), F.size(counts) - 1), F.array().cast(kind), step)


def markdown_chunks(docs: DataFrame, size: int, tok: Tokenizer, content: str = "content") -> DataFrame:
    """Adds `parts`: sections, cut between paragraphs where a section is too large; too large paragraphs become windows.

    Tokens of a run are the sum of its paragraphs'. The first paragraph of a run that began because the one before was full is set off by four line breaks."""
    c = F.coalesce(F.col(content), F.lit(""))
    d = docs.withColumn("_s", F.transform(markdown_sections(c), lambda s: F.split(s, "\n\n", -1)))
    d = d.withColumn("_p", F.flatten("_s")).withColumn("_k", F.flatten(F.transform("_s", lambda ps, k: F.array_repeat(k, F.size(ps)))))
    d = d.withColumn("_n", tok.counts(F.col("_p")))
    large = F.transform(F.arrays_zip(F.col("_p").alias("p"), F.col("_n").alias("n")), lambda x: F.when(x["n"] > size, x["p"]).otherwise(""))
    d = d.withColumn("_w", tok.windows(large, size, MARKDOWN_OVERLAP))
    d = d.withColumn("_r", F.when(F.size("_n") > 0, _packs(F.col("_n"), F.col("_k"), size)).otherwise(F.array()))

    def text(r: Column) -> Column:
        own = F.slice("_p", r["at"] + 1, r["len"])
        rest = F.array_join(F.slice("_p", r["at"] + 2, F.greatest(r["len"] - 1, F.lit(0))), "\n\n")
        joined = F.when(r["again"] & (r["len"] > 1), F.concat(F.get(own, F.lit(0)), F.lit("\n\n\n\n"), rest)).otherwise(F.array_join(own, "\n\n"))
        alone = F.size(F.get("_s", F.get("_k", r["at"]))) == 1
        return F.filter(F.array(_stripped(joined)), lambda t: (t != "") | alone)  # an empty run counts only as a whole section

    parts = F.flatten(F.transform("_r", lambda r: F.when(r["wide"], F.get("_w", r["at"])).otherwise(text(r))))
    return d.withColumn("parts", parts).drop("_s", "_p", "_k", "_n", "_w", "_r")


def with_parts(docs: DataFrame, strategy: str, size: int, overlap: int, tok: Tokenizer, content: str = "content") -> DataFrame:
    """Adds `parts` by strategy: 'markdown', 'custom' (byte slices), and fixed windows for any other name."""
    if strategy == "markdown":
        return markdown_chunks(docs, size, tok, content)
    if strategy == "custom":

        @F.pandas_udf("array<string>")
        def slices(col: pd.Series) -> pd.Series:
            return col.map(lambda t: byte_slices(t, size) if t else [])

        return docs.withColumn("parts", slices(F.col(content)))
    return docs.withColumn("parts", F.get(tok.windows(F.array(F.coalesce(F.col(content), F.lit(""))), size, overlap), F.lit(0)))


def strategy_chunks(docs: DataFrame, strategy: str, size: int, overlap: int, tok: Tokenizer, key: str = "id", content: str = "content") -> DataFrame:
    """(id, chunk_index, chunk)."""
    own = docs.select(F.col(key).cast("string").alias("id"), F.col(content).alias("content"))
    return with_parts(own, strategy, size, overlap, tok).select("id", F.posexplode("parts").alias("chunk_index", "chunk"))


def auto_chunk(docs: DataFrame, threshold: int, size: int, overlap: int, strategy: str = "fixed", tok: Tokenizer | None = None) -> DataFrame:
    """Parents and chunks of store rows. A row with more than `threshold` tokens and `vectorize` gets chunks by the strategy:
    they inherit metadata and tags, are to be vectorized, and the parent no longer is.

    Without a tokenizer the threshold counts estimated tokens and windows hold words; with one both count its tokens."""
    size_of = (lambda c: F.get(tok.counts(F.array(F.coalesce(c, F.lit("")))), F.lit(0))) if tok else estimate_tokens
    rows = docs.withColumn("token_count", F.coalesce("token_count", size_of(F.col("content"))))
    long = (F.col("token_count") > threshold) & F.coalesce("vectorize", F.lit(True)) & ~F.coalesce("is_chunk", F.lit(False))
    parents = rows.withColumn("vectorize", F.when(long, F.lit(False)).otherwise(F.coalesce("vectorize", F.lit(True))))
    parts = with_parts(rows.filter(long), strategy, size, overlap, tok or WordTokenizer())
    parts = parts.select("*", F.posexplode("parts").alias("k", "part"))
    chunks = parts.select(
        F.concat("id", F.lit("#"), "k").alias("id"), F.col("part").alias("content"), "metadata", "tags", F.lit(None).cast("array<float>").alias("vector"), "created_at", "updated_at",
        F.lit(False).alias("is_embedded"), F.lit(True).alias("vectorize"), F.lit(True).alias("is_chunk"), F.col("id").alias("parent_id"), F.col("k").alias("chunk_index"),
        size_of(F.col("part")).alias("token_count"), F.lit(False).alias("is_vectorized"),
    )
    return parents.unionByName(chunks.select(*parents.columns))


def chunks_of(docs: DataFrame, parent: str) -> DataFrame:
    return docs.filter((F.col("parent_id") == parent) & F.col("is_chunk")).orderBy("chunk_index", "id")


def with_parent(docs: DataFrame) -> DataFrame:
    """(id, chunk_index, parent_id, parent_content) of chunks with a living parent."""
    p = docs.select(F.col("id").alias("parent_id"), F.col("content").alias("parent_content"))
    return docs.filter("is_chunk").select("id", "chunk_index", "parent_id").join(p, "parent_id")


def neighbours(docs: DataFrame) -> DataFrame:
    """(id, parent_id, chunk_index, before, after): the chunks around each chunk."""
    w = Window.partitionBy("parent_id").orderBy("chunk_index", "id")
    return docs.filter("is_chunk and parent_id is not null").select(
        "id", "parent_id", "chunk_index", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after")
    )


def rechunk(docs: DataFrame, parent: str, size: int, overlap: int) -> DataFrame:
    """Rows with the parent's chunks replaced by fixed windows; the parent row stays as it is."""
    kept = docs.filter(~((F.col("parent_id") == parent) & F.col("is_chunk")) | F.col("parent_id").isNull())
    own = auto_chunk(docs.filter(F.col("id") == parent).withColumn("vectorize", F.lit(True)).withColumn("is_chunk", F.lit(False)), -1, size, overlap)
    return kept.unionByName(own.filter("is_chunk").select(*docs.columns))
