"""WARC archives, and their capture index by external merge.

Pages become WARC/1.1 records: of records with equal payloads of at least
``MIN_PAYLOAD`` bytes, the one with the smallest page id is a response and the others
are revisits that refer to it; smaller payloads are all responses. Which is which is
decided on ids and digests alone, and joined to the pages by id. Spark's own writer
puts the records into gzip files of the shared folder under its commit protocol, so a
lost executor's part is written anew. The archives are then read back, record by
record; each archive gives a run of captures, sorted once by URL key, timestamp and
page id, and kept as blocks of ``BLOCK`` captures with their first and last key.

The merge is external. Cuts from a sample of the blocks' first keys divide the keys
into ranges; a block goes to each range that it reaches into. In a range blocks come in
the order of their first keys, and a loser tree merges the runs: it takes in a block only
when the merge has come to its first key, so that one block a run is held, however many
captures the range has. Of more than ``FAN_IN`` runs, groups are merged into longer runs
before. The result is one global order, numbered from 1.

A hot URL spreads over ranges, as the key has timestamp and id. An archive's captures
(``RECORDS_PER_FILE`` at most) are the only thing sorted in Python.

Defined results: null html is an empty payload; null URLs are empty; null ids come
last and are never referred to; rows repeating an id are archived each, and ties keep
any order; payloads of any length are written and digested whole; empty input gives
empty output. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import json
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import give_back, named
from maskloom.runtime import cut, shared_dir, ship

MIN_PAYLOAD, RECORDS_PER_FILE = 100, 1000
BLOCK, FAN_IN = 256, 512
RANGE_ROWS, MAX_RANGES, KEYS_A_RANGE, KEY_CHARS = 10_000, 2_000, 20, 512
END = "\r\n\r\n"
INDEX = ("url_key string, captured_at string, page_id long, url string, record_type string, refers_to long, "
         "payload_bytes long, payload_digest string, archive string, offset long")
NAMES = [c.split()[0] for c in INDEX.split(", ")]
BLOCKS = "run string, seq int, n int, first string, last string, captures string"


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then path and query; no scheme, www, default port or fragment."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^#]*)", url)
    if not m:
        return url.split("#")[0].lower()
    host = re.sub(r"^www\d*\.", "", re.sub(r":(?:80|443)?$", "", m[1].rpartition("@")[2].lower()))
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(record): one WARC record, without its closing line ends, for every row."""
    rows = pages.select(
        named(id_col).cast("long").alias("id"), F.coalesce(named(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(named(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    held = rows.where((F.col("bytes") >= min_payload) & F.col("id").isNotNull()).groupBy("id", "digest").agg(F.count("*").alias("n"))
    firsts = cut(held.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("ids")).where(F.col("ids") > 1).drop("ids"))
    # both sides of the join by digest are bare shuffles of narrow rows, which adaptive execution splits at a hot digest
    later = held.select("id", "digest").join(firsts, "digest").where(F.col("id") != F.col("first")).select(
        F.col("id").alias("of"), F.col("digest").alias("its"), "first")
    rows = rows.join(later, (F.col("id") == F.col("of")) & (F.col("digest") == F.col("its")), "left")
    revisit = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        F.md5(F.concat(F.lit("page:"), F.coalesce(c.cast("string"), F.lit("")))), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")),
                    line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.pmod("id", F.lit(2**31)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = rows.select("id", "url", "bytes", "digest", "first", revisit.alias("revisit"), block.alias("block"), when.alias("when"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return rows.select(F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))), line("WARC-Target-URI", target), line("WARC-Date", F.col("when")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", name(F.col("first"))), line("X-Refers-To-Page", F.col("first").cast("string")))).otherwise(""),
        F.when(F.col("id").isNotNull(), line("X-Page-Id", F.col("id").cast("string"))).otherwise(""),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block"),
    ).alias("record"))


def write(pages: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE, **options) -> None:
    """Write gzip archives; each record ends with two line ends, as the format has it."""
    records(pages, **options).write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file).mode("errorifexists").text(folder)


def parse(stream: BinaryIO, archive: str = "") -> Iterator[tuple]:
    """The captures of an archive, rows of ``INDEX`` in the order of the file; no payload is held."""
    at = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {at} of {archive}")
        size, head = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode("utf-8").removesuffix("\r\n").partition(":")
            head[name] = value.removeprefix(" ")
        size += len(line)
        left, digest = int(head["Content-Length"]), hashlib.sha256()
        while left and (line := stream.readline(left)) not in (b"\r\n", b""):  # the head of the response
            size, left = size + len(line), left - len(line)
        if left:
            size, left = size + len(line), left - len(line)
        payload = left
        while left and (part := stream.read(min(left, 1 << 20))):
            digest.update(part)
            size, left = size + len(part), left - len(part)
        if left or stream.read(len(END)) != END.encode():
            raise ValueError(f"record at {at} of {archive} does not end where it says")
        kind, claimed = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
        length = int(head["X-Payload-Length"])
        if kind == "response" and (payload != length or digest.hexdigest() != claimed):
            raise ValueError(f"payload at {at} of {archive} differs from its digest")
        page, first, url = head.get("X-Page-Id"), head.get("X-Refers-To-Page"), head["WARC-Target-URI"]
        yield (url_key(url), head["WARC-Date"], int(page) if page else None, url, kind, int(first) if first else None, length, claimed, archive, at)
        at += size + len(END)


def merge_key(row) -> str:
    """URL key, timestamp and page id (null last) as one text that sorts as they do."""
    page = "1" if row[2] is None else f"0{row[2] + 2**63:020d}"
    return row[0].replace("\0", "\0\1") + "\0\0" + row[1] + "\0" + page


def _blocks(run: str, rows: list[tuple]) -> Iterator[tuple]:
    """A run's sorted captures as rows of ``BLOCKS``."""
    for seq, at in enumerate(range(0, len(rows), BLOCK)):
        part = rows[at : at + BLOCK]
        yield run, seq, len(part), merge_key(part[0]), merge_key(part[-1]), json.dumps(part, ensure_ascii=False)


def _block_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])


def read(spark, folder: str) -> DataFrame:
    """The runs of all archives, sorted, in blocks."""
    ship(spark)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                with gzip.GzipFile(fileobj=io.BytesIO(content)) as stream:
                    rows = sorted(parse(io.BufferedReader(stream), name), key=merge_key)
                if rows:
                    yield _block_frame(list(_blocks(name, rows)))
        give_back()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInPandas(of, BLOCKS)


class LoserTree:
    """Merges sorted runs that come block by block: inner nodes hold the losers of their matches, the winner is on top."""

    def __init__(self, key):
        self.key = key
        self.slot: dict = {}  # runs that have rows here
        self.free: list[int] = []
        self.rows: list[list] = []
        self.at: list[int] = []
        self.heads: list = []  # None: no rows left
        self.tree: list[int] = []

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, slot: int) -> None:
        node = (slot + len(self.heads)) // 2
        while node > 0:
            rival = self.tree[node]
            if rival < 0:  # first to come waits for its match
                self.tree[node] = slot
                return
            if self._before(rival, slot):
                self.tree[node], slot = slot, rival
            node //= 2
        self.tree[0] = slot

    def feed(self, run, rows: list) -> None:
        """The next rows of a run; none of them comes before what has been taken."""
        if not rows:
            return
        slot = self.slot.get(run)
        if slot is None:
            if self.free:
                slot = self.free.pop()
            else:
                slot = len(self.heads)
                self.rows.append([])
                self.at.append(0)
                self.heads.append(None)
            self.slot[run] = slot
            self.rows[slot], self.at[slot] = rows, 0
        else:
            self.rows[slot], self.at[slot] = self.rows[slot][self.at[slot] :] + rows, 0
        self.heads[slot] = self.key(self.rows[slot][0])
        self.tree = [-1] * len(self.heads)
        for one in range(len(self.heads)):
            self._play(one)

    def peek(self):
        """The key of the row to come, None if there is none."""
        return self.heads[self.tree[0]] if self.heads else None

    def take(self):
        slot = self.tree[0]
        row = self.rows[slot][self.at[slot]]
        self.at[slot] += 1
        if self.at[slot] < len(self.rows[slot]):
            self.heads[slot] = self.key(self.rows[slot][self.at[slot]])
        else:
            self.heads[slot], self.rows[slot] = None, []
            self.slot = {run: s for run, s in self.slot.items() if s != slot}
            self.free.append(slot)
        self._play(slot)
        return row


def _merged(batches: Iterator[pd.DataFrame], bounds) -> Iterator[tuple[int, tuple]]:
    """(part, capture) in order, from blocks sorted by part and first key; ``bounds`` gives the keys that a part begins at and ends before."""
    part, low, high, tree = None, None, None, LoserTree(merge_key)
    for batch in batches:
        for of, run, first, captures in zip(batch["part"].tolist(), batch["run"], batch["first"], batch["captures"]):
            if of != part:
                while tree.peek() is not None:
                    yield part, tree.take()
                part, tree = of, LoserTree(merge_key)
                low, high = bounds(part)
            while (head := tree.peek()) is not None and head < first:
                yield part, tree.take()
            rows = [tuple(r) for r in json.loads(captures)]
            keys = list(map(merge_key, rows))
            tree.feed(run, rows[bisect.bisect_left(keys, low) if low is not None else 0 : bisect.bisect_left(keys, high) if high is not None else None])
    while tree.peek() is not None:
        yield part, tree.take()


def _fewer_runs(blocks: DataFrame, groups: int, level: int) -> DataFrame:
    """Every group of runs merged into one run."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, seq, rows = None, 0, []

        def flush() -> pd.DataFrame:
            out = [(f"{level}-{run}", seq, *b[2:]) for b in _blocks("", rows)]
            return _block_frame(out)

        for part, row in _merged(batches, lambda part: (None, None)):
            if rows and (part != run or len(rows) == BLOCK):
                yield flush()
                rows, seq = [], seq + 1 if part == run else 0
            run = part
            rows.append(row)
        if rows:
            yield flush()
        give_back()

    dealt = blocks.withColumn("part", F.pmod(F.xxhash64(F.lit(level), "run"), F.lit(groups)).cast("int")).repartition(groups, "part")
    return dealt.sortWithinPartitions("part", "first", "run", "seq").mapInPandas(of, BLOCKS)


def merge(blocks: DataFrame, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures of the runs in global order, which ``history_pos`` counts from 1."""
    spark = blocks.sparkSession
    ship(spark)
    blocks, level = cut(blocks), 0
    while (runs := blocks.select("run").distinct().count()) > fan_in:
        level += 1
        blocks = cut(_fewer_runs(blocks, -(-runs // fan_in), level))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, min(MAX_RANGES, -(-int(total) // range_rows)))
    sample = blocks.select(F.substring("first", 1, KEY_CHARS).alias("key"), F.xxhash64("run", "seq").alias("h")).orderBy("h").limit(KEYS_A_RANGE * ranges)
    keys = sorted(r["key"] for r in sample.collect())
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    bounds = lambda part: (cuts[part - 1] if part else None, cuts[part] if part < len(cuts) else None)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, at = [], (None, 0)
        for part, row in _merged(batches, bounds):
            at = (part, at[1] + 1 if part == at[0] else 0)
            rows.append((*row, *at))
            if len(rows) == 10_000:
                yield _frame(rows)
                rows = []
        if rows:
            yield _frame(rows)
        give_back()

    places = F.from_json(F.lit(json.dumps(cuts)), "array<string>")
    behind = lambda key: F.size(F.filter(places, lambda c: c <= F.col(key))).cast("int")
    dealt = blocks.withColumn("part", F.explode(F.sequence(behind("first"), behind("last"))))
    dealt = dealt.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "first", "run", "seq")
    merged = cut(dealt.select("part", "run", "first", "captures").mapInPandas(of, INDEX + ", merge_part int, merge_pos long"))
    sizes = {r["merge_part"]: r["count"] for r in merged.groupBy("merge_part").count().collect()}  # a row for each range
    before, offsets = 0, []
    for part in range(len(cuts) + 1):
        offsets.append(before)
        before += sizes.get(part, 0)
    begin = F.get(F.from_json(F.lit(json.dumps(offsets)), "array<long>"), F.col("merge_part"))
    return merged.withColumn("history_pos", begin + F.col("merge_pos") + 1)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*NAMES, "merge_part", "merge_pos"]).astype({"page_id": "Int64", "refers_to": "Int64"})


def capture_histories(pages: DataFrame, folder: str | None = None, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS, **options) -> DataFrame:
    """Write ``pages`` as archives (into a new folder of the shared one by default), read
    them back, and give their captures in global order."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, **options)
    return merge(read(spark, folder), fan_in, range_rows)
