"""WARC derivatives: response records into linked metadata and plain-text conversion records.

For every response a ``metadata`` record (language hint, title, links, sizes) and a ``conversion`` record (the visible text) are
built. Both name the response in ``WARC-Refers-To``, and carry over its target URI, date and payload digest
(``WARC-Refers-To-Payload-Digest``) and the source headers (``X-Source-*``); each has its own block digest and length. Record ids
are URNs derived from the source id and the record type, so a rerun gives the same ids.

Records are written as WARC files by Spark's text writer: every row is a record, and the separator between rows is the two empty
lines that end a WARC record. Blocks hold no carriage return, so the separator can't occur in them. Reading splits at
the version line, which no line of a block can equal, as block lines that start with ``WARC/`` are indented by a space.

Null or empty html gives a response with an empty payload, whose conversion has an empty block; null urls are empty;
repeated pages give equal records; an empty table writes no records.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmart.llm.common import whole_text

VERSION = "WARC/1.1"
DATE = "2025-01-01T00:00:00Z"  # the tables have no fetch time
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, URLs
RESPONSE = "page_id long, record_id string, url string, date string, http_headers string, payload string, payload_digest string"


def digest(data: str) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data.encode("utf-8", "surrogatepass")).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(31).join(map(str, parts)))}>"


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records of a page table, with the headers a server would have sent."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame({"page_id": pdf["k"], "record_id": [record_id("response", k, u) for k, u in zip(pdf["k"], pdf["u"])],
                                "url": pdf["u"], "date": DATE})
            out["http_headers"] = [f"HTTP/1.1 200 OK\nContent-Type: text/html; charset=utf-8\nContent-Length: {len(t.encode())}" for t in pdf["t"]]
            out["payload"] = pdf["t"]
            out["payload_digest"] = [digest(t) for t in pdf["t"]]
            yield out.astype({"page_id": "Int64"})

    rows = pages.select(F.col(key).cast("long").alias("k"), whole_text(url).alias("u"), whole_text(html).alias("t"))
    return rows.mapInPandas(work, RESPONSE)


_DROP = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|"
                    r"section|table|tbody|td|tfoot|th|thead|title|tr|ul|html|body|head)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z\-]+)", re.I)
_HREF = re.compile(r"<a\b(?:[^>]*\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)')|(?:[^>\"']|\"[^\">]*\"|'[^'>]*')*?\shref\s*=\s*([^\s\"'>][^\s>]*))", re.I)


def visible_text(page: str) -> str:
    """The page's text: scripts, styles and comments dropped, a line per block, white space folded, character references resolved."""
    # the page's own line ends are spaces; runs of white space fold when a line is split below
    body = _TAG.sub("", _BLOCK.sub("\n", _DROP.sub("", page.replace("\n", " ").replace("\r", " "))))
    lines = (" ".join(html_lib.unescape(x).replace("\r", " ").split()) for x in body.split("\n"))
    return "\n".join((" " + x if x.startswith("WARC/") else x) for x in lines if x)


def page_facts(page: str) -> dict:
    title, lang = _TITLE.search(page), _LANG.search(page)
    return {"title": " ".join(html_lib.unescape(_TAG.sub("", title.group(1))).split()) if title else "", "lang": lang.group(1).lower() if lang else "",
            "outlinks": [html_lib.unescape(a or b or c) for a, b, c in _HREF.findall(_DROP.sub("", page))], "payload_bytes": len(page.encode("utf-8", "surrogatepass"))}


def _record(kind: str, rid: str, r, content_type: str, block: str) -> str:
    """A record without its closing empty lines."""
    clean = lambda s: re.sub(r"[\r\n]+", " ", s)
    source = [f"X-Source-{name.strip()}: {value.strip()}" for name, _, value in
              (line.partition(":") for line in r.http_headers.split("\n")[1:])]
    headers = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {r.date}", f"WARC-Target-URI: {clean(r.url)}",
               f"WARC-Refers-To: {r.record_id}", f"WARC-Refers-To-Target-URI: {clean(r.url)}", f"WARC-Refers-To-Date: {r.date}",
               f"WARC-Refers-To-Payload-Digest: {r.payload_digest}", *source, f"WARC-Block-Digest: {digest(block)}", f"Content-Type: {content_type}",
               f"Content-Length: {len(block.encode('utf-8', 'surrogatepass'))}"]
    return "\r\n".join(headers) + "\r\n\r\n" + block


def derive(responses_: DataFrame) -> DataFrame:
    """page_id, kind, record: the metadata and the conversion record of every response."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                text = visible_text(r.payload)
                conversion, metadata = record_id("conversion", r.record_id), record_id("metadata", r.record_id)
                facts = page_facts(r.payload) | {"conversion": conversion, "text_bytes": len(text.encode("utf-8", "surrogatepass"))}
                fields = "\n".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in facts.items())
                rows.append((r.page_id, "metadata", _record("metadata", metadata, r, "application/warc-fields", fields)))
                rows.append((r.page_id, "conversion", _record("conversion", conversion, r, "text/plain; charset=utf-8", text)))
            yield pd.DataFrame(rows, columns=["page_id", "kind", "record"]).astype({"page_id": "Int64"})

    return responses_.mapInPandas(work, "page_id long, kind string, record string")


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """The records' files, by Spark's text writer (see the module)."""
    records.select("record").write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """kind, record_id, url, refers_to, payload_digest, source_type, block_digest, content_length, block from WARC files."""
    rows = spark.read.option("lineSep", f"{VERSION}\r\n").text(path).where("value != ''")
    # a record is its header lines, an empty line and the block; the separator after it goes
    value = F.col("value")
    cut = F.instr(value, "\r\n\r\n")
    head = F.substring(value, F.lit(1), cut - 1)
    rows = rows.select(head.alias("head"), F.substring(value, cut + 4, F.length(value) - cut - 7).alias("block"))
    field = lambda name: F.regexp_extract("head", rf"(?m)^{name}: (.*?)\r?$", 1)
    return rows.select(field("WARC-Type").alias("kind"), field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("url"),
                       field("WARC-Refers-To").alias("refers_to"), field("WARC-Refers-To-Payload-Digest").alias("payload_digest"),
                       field("X-Source-Content-Type").alias("source_type"), field("WARC-Block-Digest").alias("block_digest"),
                       field("Content-Length").cast("long").alias("content_length"), "block")
