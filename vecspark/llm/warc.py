"""Not-modified revisits of web captures, resolved to the full response they stand for.

A revisit (status 304) belongs to the latest earlier full response of the same canonical URL. If its validators agree with that response, its body is
the response's, and of its headers those that a 304 may update replace the stored ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Headers that a 304 response may update, in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Time units of a block: the captures of one URL inside it are put in order by one task.
BLOCK = 86_400


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no user, default port or fragment, ``/`` for an empty path, query parameters in order; null stays null.

    Text that is no absolute URL stays as it is, without its fragment.
    """
    plain = F.split_part(F.trim(url), F.lit("#"), F.lit(1))
    scheme, rest = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)), F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.\-]*://(.*)$", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), ordered)))
    return F.when(scheme == "", plain).otherwise(whole)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve(captures: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each revisit of ``captures`` (id, url, time long, kind ``response`` or ``revisit``, headers map with lower-case names, digest).

    id, canonical, status, response_id, headers. ``status``: ``resolved``; ``changed`` if a validator that both have differs; ``unverified`` if they have
    none in common; ``missing`` without an earlier response. Validators, the first that both have: entity tag (weak comparison),
    last-modified, digest. Headers are merged where resolved, else the revisit's own. Of responses of one time the greater id counts as the later; a response of
    the revisit's own time is not earlier. Rows with a null url, time or kind: such revisits are ``missing``, such responses serve none.
    A URL with very many captures is handled in blocks of time; what each block ends with is carried over.
    """
    c = captures.select("id", canonical_url(F.col("url")).alias("canonical"), "time", "kind", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest")
    stored = F.when((F.col("kind") == "response") & F.col("time").isNotNull() & F.col("canonical").isNotNull(), F.struct("time", "id", "headers", "digest"))
    c = c.withColumn("_b", F.floor(F.col("time") / block)).withColumn("_own", stored)
    inside = Window.partitionBy("canonical", "_b").orderBy("time", F.col("_own").isNotNull(), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = c.withColumn("_near", F.last("_own", ignorenulls=True).over(inside)).where("kind = 'revisit'").drop("_own")
    ends = c.groupBy("canonical", "_b").agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), F.struct("time", "id"))).alias("_end"))
    before = Window.partitionBy("canonical").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_far", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    r, e = rows.alias("r"), carried.alias("e")
    both = r.join(e, (F.col("r.canonical") == F.col("e.canonical")) & (F.col("r._b") == F.col("e._b")), "left").select("r.*", "e._far")
    both = both.withColumn("_of", F.when(F.col("time").isNotNull() & F.col("canonical").isNotNull(), F.coalesce("_near", "_far")))

    def header(of: str, name: str) -> Column:
        return F.col(of).getItem(name)

    tag, other = _weak(header("headers", "etag")), _weak(header("_of.headers", "etag"))
    changed, stored_changed = header("headers", "last-modified"), header("_of.headers", "last-modified")
    agree = F.coalesce(tag == other, changed == stored_changed, F.col("digest") == F.col("_of.digest"))
    status = F.when(F.col("_of").isNull(), "missing").when(agree, "resolved").when(~agree, "changed").otherwise("unverified")
    updates = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(F.col("_of.headers"), lambda k, v: ~F.array_contains(F.map_keys(updates), k)), updates)
    out = both.withColumn("status", status)
    return out.select("id", "canonical", "status", F.when(F.col("status") == "resolved", F.col("_of.id")).alias("response_id"), F.when(F.col("status") == "resolved", merged).otherwise(F.col("headers")).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures made from a table of pages: each page is a full response, and its URL is asked for again twice.

    The first time soon after, with the entity tag of the page; the second time a day later, with another spelling of the URL and a tag that
    is stale for every third page.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    base = pages.select("page_id", "url", tag.alias("tag"), F.sha2(html, 256).alias("digest"))
    time = F.col("page_id") * 600
    response = base.select((F.col("page_id") * 3).alias("id"), "url", time.alias("time"), F.lit("response").alias("kind"), F.create_map(F.lit("etag"), "tag", F.lit("content-type"), F.lit("text/html"), F.lit("date"), time.cast("string")).alias("headers"), "digest")
    soon = base.select((F.col("page_id") * 3 + 1).alias("id"), "url", (time + 60).alias("time"), F.lit("revisit").alias("kind"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), "tag"), F.lit("content-type"), F.lit("x/ignored"), F.lit("date"), (time + 60).cast("string")).alias("headers"), "digest")
    stale = F.when(F.col("page_id") % 3 == 0, F.lit('"stale"')).otherwise(F.col("tag"))
    late = base.select((F.col("page_id") * 3 + 2).alias("id"), F.concat("url", F.lit("#again")).alias("url"), (time + 86_400).alias("time"), F.lit("revisit").alias("kind"), F.create_map(F.lit("etag"), stale, F.lit("date"), (time + 86_400).cast("string")).alias("headers"), "digest")
    return response.unionByName(soon).unionByName(late)


CAPTURES = "record string, url string, time long, kind string, headers map<string,string>, digest string, status int"


def _plain(content: bytes) -> bytes:
    """A file's records; members of a compressed file are put together. What a broken member still holds is kept."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content))
        except zlib.error:
            break
        content = member.unused_data
    return b"".join(out)


def _fields(block: bytes) -> dict[str, str]:
    """Header lines as lower-case names and values; of a repeated name the last counts."""
    lines = block.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if v}


def _cut(block: bytes) -> tuple[bytes, int]:
    """What stands before the first empty line, and where it ends; -1 if there is none."""
    ends = [(at, n) for sign in (b"\r\n\r\n", b"\n\n") if (at := block.find(sign)) >= 0 for n in [len(sign)]]
    return (block[: min(ends)[0]], sum(min(ends))) if ends else (block, -1)


def records(content: bytes) -> Iterator[tuple]:
    """Captures in a file: responses and revisits. Other records, and what is no record, are passed over."""
    content, at = _plain(content), 0
    while (at := content.find(b"WARC/", at)) >= 0:
        head, size = _cut(content[at : at + 65_536])
        if size < 0:
            return
        told = _fields(head.partition(b"\n")[2])
        begins = at + size
        try:
            length = int(told.get("content-length", ""))
        except ValueError:
            at = begins
            continue
        kind, body = told.get("warc-type", ""), content[begins : begins + length]
        at = begins + length
        if kind in ("response", "revisit"):
            http, _ = _cut(body)
            first, _, rest = http.partition(b"\n")
            said = first.split()
            status = int(said[1]) if len(said) > 1 and said[0].startswith(b"HTTP/") and said[1].isdigit() else None
            try:
                time = int(datetime.fromisoformat(told.get("warc-date", "").replace("Z", "+00:00")).timestamp())
            except ValueError:
                time = None
            yield told.get("warc-record-id"), told.get("warc-target-uri"), time, kind, list(_fields(rest).items()), told.get("warc-payload-digest"), status


def read(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the files at ``path``, plain or compressed: id (a hash of the record's own), url, time in seconds, kind, headers,
    digest, status; as ``resolve`` takes them. A task reads a file. Broken dates are null; files without records give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32()]
        names = [x.split()[0] for x in "record string,url string,time long,kind string,headers map,digest string,status int".split(",")]
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for row in records(content.as_py()):
                    rows.append(row)
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, CAPTURES)
    return found.select(F.xxhash64("record").alias("id"), "url", "time", "kind", "headers", "digest", "status")
