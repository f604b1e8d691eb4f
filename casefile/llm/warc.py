"""WARC archives: written with Spark's text sink, read back by boundary-chain verification.

The reader cuts files at the magic, which also occurs inside payloads. A first pass therefore emits
candidates, without payloads: the offset of a magic, and that of the successor its Content-Length
names. Pointer jumping within each split contracts the chains to (candidate, exit); pointer jumping
over the exits, from the start of each file, finds where chains enter each split; a last jump within
the splits marks the candidates that a chain reaches. All others lie inside payloads, and their bytes
go back to the record that holds them. A second pass over the files takes the payloads along. Rounds:
the logarithm of a file's number of splits. Memory: a few batches of pieces, and of a split the
numbers of its candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.llm.store import by_count, cleared, deleted, dropped, new_path, written

MAGIC = b"WARC/1."
END = "\r\n\r\n"
MIN_REVISIT_BYTES = 100
#: Bytes of payload in a batch that leaves Python, but for a single larger one.
BATCH_BYTES = 16 << 20
_HEAD = re.compile(rb"[0-9]\r\n((?:[^\r\n]+\r\n)+)\r\n")
#: A head that ends where the piece does: a magic within it cut it.
_OPEN = re.compile(rb"[0-9]\r\n(?:[^\r\n]+\r\n)*[^\r\n]*\Z")


def _header(name: str, value: Column) -> Column:
    """A magic in the value gets its dot percent-encoded (the same URI): readers of splits see no cut head."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.replace(F.translate(value.cast("string"), "\r\n", "  "), F.lit(MAGIC.decode()), F.lit("WARC/1%2E")), F.lit("\r\n"))).otherwise("")


def records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(id, type, refers_to, digest, bytes, record)`` per row; ``record`` lacks the closing line ends.

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest id are responses
    and the others revisits of it; a null id is always a response. A null payload is empty.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    # payloads stay where they are: only ids and digests are shuffled, then the list of revisits
    named = rows.filter(F.col("id").isNotNull() & (F.col("bytes") >= least)).select("id", "digest")
    first = named.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    again = named.join(first, "digest").filter("id <> first").select("id", "digest", F.col("first").alias("refers_to")).distinct()
    again = by_count(written(again, "revisits"))  # payloads are shuffled only where the list is long
    rows = rows.join(again, ["id", "digest"], "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", kind),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"), _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"), _header("Content-Length", F.octet_length(body)), F.lit("\r\n"),
    )
    return rows.select("id", kind.alias("type"), "refers_to", "digest", "bytes", F.concat(head, body).alias("record"))


def write_warc(pages: DataFrame, path: str, compression: str = "none", **columns) -> None:
    """One archive per task. The text sink's separator is the record's end, so files are plain WARC, and
    readers can split them; whole-file compression keeps each file in one split."""
    records(pages, **columns).select("record").write.option("lineSep", END).option("compression", compression).text(path)


def _parsed(piece: bytes) -> tuple[int, int, list[tuple[str, str]]] | None:
    """(bytes of the head after the magic, Content-Length, headers) of what follows a magic."""
    head = _HEAD.match(piece)
    if not head:
        return None
    pairs = [line.partition(b":") for line in head[1].split(b"\r\n")[:-1]]
    headers = [(k.strip().decode("utf-8", "replace").lower(), v.strip().decode("utf-8", "replace")) for k, _, v in pairs]
    length = dict(headers).get("content-length", "")
    return (head.end(), int(length), headers) if length.isascii() and length.isdigit() else None


def _index(starts: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Position in ``starts`` of each successor, and of the candidate itself where it has none here."""
    at = np.minimum(np.searchsorted(starts, after), max(0, len(starts) - 1))
    return np.where(starts[at] == after, at, np.arange(len(starts))) if len(starts) else at


_SPLIT = "file string, block long"


def _after(rel: int, found: tuple[int, int, list] | None) -> int:
    return rel + len(MAGIC) + found[0] + found[1] + len(END) if found else -1 << 40


class _OpenHeads:
    """Heads that magics within them have cut, while they wait for their blank line; each byte is looked at once.

    They all end at the same blank line, so of what follows only the last Content-Length and its place are
    kept. A line that a magic cuts cannot hold a number, whatever its name."""

    def __init__(self) -> None:
        self.rels: list[int] = []
        self.length: tuple[int, int | None] = (-1, None)  # place of the last such line, and its number
        self.cut = False  # the line in progress is a Content-Length that a magic cuts

    def opened(self, rel: int, piece: bytes) -> None:
        """A head whose version line and first lines are ``piece``, up to a magic."""
        self.rels.append(rel)
        self._lines(piece[3:], rel + len(MAGIC) + 3)

    def _lines(self, data: bytes, at: int) -> None:
        for line in data.split(b"\r\n")[:-1]:
            self._line(line, at)
            at += len(line) + 2
        name, colon, _ = data[data.rfind(b"\r\n") + 2 if b"\r\n" in data else 0 :].partition(b":")
        self.cut = bool(colon) and name.strip().lower() == b"content-length"
        if self.cut:
            self.length = at, None

    def _line(self, line: bytes, at: int) -> None:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            digits = value.strip()
            self.length = at, int(digits) if digits.isdigit() else None

    def follow(self, rel: int, piece: bytes) -> list[tuple[int, int]]:
        """(rel, successor) of the heads that the piece after the magic at ``rel`` settles; those before it."""
        end = piece.find(END.encode())
        part = piece[: end + 2] if end >= 0 else piece
        lines = part.count(b"\r\n")
        if lines != part.count(b"\r") or lines != part.count(b"\n"):
            return self.settled(None)
        first = part.find(b"\r\n") + 2
        if first > 1:  # the line in progress ends here; others follow
            self.cut = False
            self._lines(part[first:], rel + len(MAGIC) + first)
        return self.settled(rel + len(MAGIC) + end + len(END)) if end >= 0 else []

    def settled(self, end: int | None) -> list[tuple[int, int]]:
        at, number = self.length
        out = [(rel, end + number + len(END) if end is not None and number is not None and at >= rel + len(MAGIC) + 3 else _after(rel, None)) for rel in self.rels]
        self.__init__()
        return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, rel, size, after) of every piece between magics; rel and after, its successor, count from
    the split's first byte. Of a head that magics have cut only numbers are kept until it ends."""
    key, pos, rows = None, 0, []
    heads, sizes = _OpenHeads(), {}

    def batch_of() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 5
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), *[pa.int64()] * 4], strict=True)], names=["file", "block", "rel", "size", "after"])

    def settle(found: list[tuple[int, int]]) -> None:
        rows.extend((*key, rel, sizes.pop(rel), after) for rel, after in found)

    for batch in batches:
        for file, block, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != key:
                settle(heads.settled(None))
                key, pos = (file, block), 0
            rel, size = pos - len(MAGIC), len(piece)
            pos += size + len(MAGIC)
            if heads.rels:
                settle(heads.follow(rel, piece))
            if rel < 0 and block == 0:  # the bytes before a file's first magic are no candidate
                rows.append((*key, rel, size, _after(rel, None)))
            elif _OPEN.match(piece):
                sizes[rel] = size
                if heads.rels:  # its lines are part of those that the heads before it wait through
                    heads.rels.append(rel)
                else:
                    heads.opened(rel, piece)
            else:
                rows.append((*key, rel, size, _after(rel, _parsed(piece))))
            if len(rows) >= 1 << 16:
                yield batch_of()
    settle(heads.settled(None))
    yield batch_of()


def _exits(split: pa.Table) -> pa.Table:
    """A split's candidates with the end of the chain within it that begins at each."""
    split = split.sort_by("rel")
    starts, after = split.column("rel").to_numpy(), split.column("after").to_numpy()
    to = _index(starts, after)
    while True:  # pointer jumping: each round doubles the hops
        further = to[to]
        if (further == to).all():
            break
        to = further
    return split.append_column("exit", pa.array(after[to]))


def _bounded(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose last columns hold some ``BATCH_BYTES``, one larger row alone."""
    ready, size = [], 0

    def batch_of() -> pa.RecordBatch:
        cols = list(zip(*ready, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    for row in rows:
        if ready and size + len(row[-1]) > BATCH_BYTES:
            yield batch_of()
            ready, size = [], 0
        ready.append(row)
        size += len(row[-1])
    yield batch_of()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, rel, piece) of every piece."""
    key, pos = None, 0
    for batch in batches:
        for file, block, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != key:
                key, pos = (file, block), 0
            yield file, block, pos - len(MAGIC), piece
            pos += len(piece) + len(MAGIC)


_HEADERS = pa.map_(pa.string(), pa.string())


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces that are one whole record each."""
    rows = ((f, b, rel, list(dict(p[2]).items()), x[p[0] : p[0] + p[1]]) for f, b, rel, x in _placed(batches) if (p := _parsed(x)) and p[0] + p[1] + len(END) == len(x))
    yield from _bounded(rows, [pa.string(), pa.int64(), pa.int64(), _HEADERS, pa.binary()], ["file", "block", "rel", "headers", "payload"])


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _bounded(_placed(batches), [pa.string(), pa.int64(), pa.int64(), pa.binary()], ["file", "block", "rel", "piece"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(file, offset, headers, payload)`` of every record that a chain from its file's start reaches.

    Header names are lower-case; of repeated ones the last counts. A chain ends at a head that does
    not parse (also where a magic within it stands across two splits) or a length that leads to no record; what follows it in that file is not returned. Empty files
    and a file that does not begin with a record give no rows. Null, repeated and tied records do not
    exist in files; payloads of any length come back whole. The files are read again when the result is,
    by splits as now: an error tells if the session's split size has changed meanwhile.
    """
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    pieces = written(lines.mapInArrow(_cut, _SPLIT + ", rel long, size long, after long"), "pieces")
    step, split_of = F.lit(len(MAGIC)), ["file", "block"]
    totals = pieces.groupBy(*split_of).agg(F.sum(F.col("size") + step).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(totals.select(*split_of, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "splits")
    # a piece's offset is that of the magic before it, so a file's lead has a negative one
    known = pieces.groupBy(*split_of).applyInArrow(_exits, _SPLIT + ", rel long, size long, after long, exit long").join(by_count(bases), split_of)
    known = known.withColumns({c: F.col(c) + F.col("base") for c in ("rel", "after", "exit")}).withColumnRenamed("rel", "offset")
    known = written(known.filter("offset >= 0"), "candidates")
    reached = _entered(known)
    marked = written(
        known.join(by_count(reached).withColumn("entry", F.lit(True)), ["file", "offset"], "left").groupBy(*split_of).applyInPandas(_marked, _SPLIT + ", base long, offset long, size long, after long, whole boolean, reached boolean"),
        "marked",
    )
    # what is not one whole record in one piece: pieces inside payloads, and the records that hold them.
    # The holder of a piece is the last record reached, in its split or in the last split before with one
    hold = F.when(F.col("reached"), F.struct(F.col("offset").alias("at"), "after"))
    up_to = Window.partitionBy(*split_of).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    lasts = marked.groupBy(*split_of).agg(F.max(hold).alias("own")).select(*split_of, F.last("own", ignorenulls=True).over(before).alias("carried"))
    here = marked.withColumn("holder", F.last(hold, ignorenulls=True).over(up_to)).filter("not (reached and whole)")
    here = here.join(by_count(written(lasts, "carried")), split_of).withColumn("holder", F.coalesce("holder", "carried"))
    split = written(here.select(*split_of, (F.col("offset") - F.col("base")).alias("rel"), "offset", F.when(F.col("holder.after") > F.col("offset"), F.col("holder.at")).alias("owner")), "split")
    for done in (pieces, known, marked, reached):
        dropped(done)
    few = by_count(split)  # few rows or none, as a rule
    keys = [*split_of, "rel"]
    at = F.coalesce("base", F.raise_error(F.lit("the files' splits have changed since they were read first")).cast("long"))
    alone = lines.mapInArrow(_alone, _SPLIT + ", rel long, headers map<string,string>, payload binary").join(by_count(bases), split_of, "left")
    alone = alone.withColumn("offset", F.col("rel") + at).filter("offset >= 0").join(few, keys, "left_anti").select("file", "offset", "headers", "payload")
    if split.isEmpty():
        return alone
    apart = lines.mapInArrow(_raw, _SPLIT + ", rel long, piece binary").join(few, keys).filter("owner is not null")
    parts = F.array_sort(F.collect_list(F.struct("offset", "piece")))
    joined = apart.groupBy("file", F.col("owner").alias("offset")).agg(parts.alias("parts")).select("file", "offset", F.concat(
        F.element_at("parts", 1)["piece"], F.aggregate(F.slice("parts", 2, 1 << 30), F.lit(b""), lambda a, x: F.concat(a, F.lit(MAGIC), x["piece"]))
    ).alias("piece"))
    return alone.unionByName(joined.mapInArrow(_opened, "file string, offset long, headers map<string,string>, payload binary"))


def _entered(known: DataFrame) -> DataFrame:
    """``(file, offset)`` of the candidates at which a chain from a file's start enters a split."""
    jump = known.select("file", "offset", "exit").join(known.select("file", F.col("offset").alias("exit")).hint("merge"), ["file", "exit"])
    jump = written(jump.select("file", "offset", "exit"), "jump")
    reached = written(known.filter("offset = 0").select("file", "offset").distinct(), "reached")
    n = 0
    while (now := reached.count()) != n:  # after k rounds: all within 2**k - 1 hops
        n = now
        hop = reached.join(jump.hint("merge"), ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = written(reached.unionByName(hop).distinct(), "reached")
        far = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("to"))
        jump = written(jump.join(far.hint("merge"), ["file", "exit"]).select("file", "offset", F.col("to").alias("exit")), "jump")
    return reached


def _marked(split: pd.DataFrame) -> pd.DataFrame:
    split = split.sort_values("offset")
    starts, after = split["offset"].to_numpy(), split["after"].to_numpy()
    to, reached = _index(starts, after), split["entry"].eq(True).to_numpy().copy()
    while True:
        grown = reached.copy()
        grown[to[reached]] = True
        further = to[to]
        if (further == to).all() and (grown == reached).all():
            break
        reached, to = grown, further
    whole = after == starts + len(MAGIC) + split["size"].to_numpy()
    return split[["file", "block", "base", "offset", "size", "after"]].assign(whole=whole, reached=reached & (after > starts))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((f, at, list(dict(p[2]).items()), x[p[0] : p[0] + p[1]]) for batch in batches for f, at, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (p := _parsed(x)) and len(x) >= p[0] + p[1])  # else the file ends within the record
    yield from _bounded(rows, [pa.string(), pa.int64(), _HEADERS, pa.binary()], ["file", "offset", "headers", "payload"])


def archived(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and return what they hold:
    ``id, payload_bytes, payload_digest, record_type, refers_to``, one row per row of ``pages``.

    A revisit's payload is that of the response it names, looked up by id and digest among what was read.
    A null payload is empty, a null id is always a response, repeated rows are a record each, and of
    ties the smallest id is the response. Payloads of any length are written and read whole. Other columns are not
    read. Empty table: empty result. The archives are deleted once read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, id_col=id_col, payload_col=payload_col, url_col=url_col)
    page = lambda name: F.regexp_extract(F.col("headers")[name], r"^<urn:page:(-?[0-9]*)>$", 1).try_cast("long")
    kept = []
    with cleared(kept):
        found = read_warc(spark, path).select(
            page("warc-record-id").alias("id"), F.col("headers")["warc-type"].alias("record_type"), page("warc-refers-to").alias("refers_to"),
            F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("d"),
            F.regexp_extract(F.col("headers")["warc-payload-digest"], r"^sha256:([0-9a-f]{64})$", 1).alias("told"),
        )
        found = written(found, "archived")
        kept.append(found)
    deleted(spark, path)
    source = found.filter("record_type = 'response'").select(F.col("id").alias("refers_to"), F.col("d").alias("told"), F.col("n").alias("full")).distinct()
    again = found.filter("record_type = 'revisit'").join(source.hint("merge"), ["refers_to", "told"])
    out = ["id", F.col("full").alias("payload_bytes"), F.col("told").alias("payload_digest"), "record_type", "refers_to"]
    same = found.filter("record_type = 'response'").withColumn("full", F.col("n")).withColumn("told", F.col("d"))
    return same.select(*out).unionByName(again.select(*out))
