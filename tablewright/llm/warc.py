"""WARC derivatives: metadata and plain-text conversion records linked to the responses they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Elements whose content is not text, elements that end a line, and named characters.
SKIPPED = ("script", "style", "template", "noscript")
LINES = (
    "p", "div", "br", "li", "ul", "ol", "h[1-6]", "tr", "td", "th", "table", "section", "article", "header", "footer",
    "nav", "aside", "main", "blockquote", "pre", "dl", "dt", "dd", "form", "hr", "body", "html", "figure", "option",
)
NAMED = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "hellip": "…",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€",
}
END = "\r\n"


def _numbered(text: Column) -> Column:
    """Numeric character references, decimal or hexadecimal, become their characters; invalid ones stay."""

    def piece(p: Column, i: Column) -> Column:
        number = F.regexp_extract(p, r"^(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});", 1)
        code = F.when(number.startswith("x"), F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(number).cast("int")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.regexp_replace(p, r"^[^;]*;", "")
        return F.when(i == 0, p).when((number != "") & valid, F.concat(char, rest)).otherwise(F.concat(F.lit("&#"), p))

    return F.when(text.contains("&#"), F.array_join(F.transform(F.split(text, "&#"), piece), "")).otherwise(text)


def characters(text: Column) -> Column:
    """Character references resolved, each once."""
    text = _numbered(text)
    for name, char in NAMED.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


# What goes with its content; the head too, if it ends. Patterns mean the same to Java and to RE2.
GONE = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(rf"<{n}\b.*?(?:</{n}\s*>|\z)" for n in SKIPPED) + r"|<head\b.*?</head\s*>"
LINE = rf"(?i)</?(?:{'|'.join(LINES)})\b[^>]*>"
TAG = r"<[/!?a-zA-Z][^>]*(?:>|\z)"
BLANK = r"[ \t\r\f\x0B\x{A0}]{2,}|[\t\r\f\x0B\x{A0}]"       # a single space stays as it is
BREAK = r" ?\n[ \n]*"


def without_markup(html: Column) -> Column:
    """No comments, head, scripts or tags; a line for each block."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, GONE, " "), LINE, "\n"), TAG, "")


def narrowed(text: Column) -> Column:
    """Runs of white space as one space or one line end, none at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, BLANK, " "), BREAK, "\n"), F.lit(" \n"))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B\x{A0}]+", " "))


def record_id(*parts: Column) -> Column:
    """A urn:uuid made from the parts, the same each time."""
    h = F.md5(F.concat_ws(" ", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def derive(
    responses: DataFrame, key: str = "record_id", uri: str = "target_uri", date: str = "date", headers: str = "headers", payload: str = "payload",
    carry: list[str] | None = None,
) -> DataFrame:
    """Two rows for each response row: kind (metadata or conversion), record_id, refers_to, target_uri,
    date, content_type, content_length, block_digest, source_digest, header and block.

    ``refers_to`` is the response's record id; the digest of its payload is kept as it is given in the header
    ``WARC-Payload-Digest`` (any case), else computed. The metadata block lists title, language, characters,
    links, every link and all headers of the response (``headers`` is a map) as ``source-…`` lines. A null id, URI or date counts
    as empty and a null payload as no content; columns named in ``carry`` are kept (under their own names, which must not clash); long pages are converted whole; repeated rows give the
    same records again; an empty table gives no rows; other columns are not read.
    """
    empty, carry = F.lit(""), carry or []
    rows = responses.select(
        *carry,
        F.coalesce(F.col(key).cast("string"), empty).alias("refers_to"), F.coalesce(F.col(uri).cast("string"), empty).alias("target_uri"),
        F.coalesce(F.col(date).cast("string"), empty).alias("date"), F.col(headers).alias("source_headers"),
        F.coalesce(F.col(payload).cast("string"), empty).alias("html"),
    )
    given = F.filter(F.map_entries("source_headers"), lambda e: F.lower(e["key"]) == "warc-payload-digest")
    link = F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"'), F.lit(1))
    # One step at a time: what a later step reads more than once is then computed once.
    rows = rows.select(
        *carry, "refers_to", "target_uri", "date", without_markup(F.col("html")).alias("bare"), link.alias("links"),
        F.coalesce(F.get(given, 0)["value"], digest(F.col("html"))).alias("source_digest"),
        characters(one_line(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))).alias("title"),
        F.lower(F.regexp_extract("html", r'(?i)<html\b[^>]*?\blang\s*=\s*"?([A-Za-z0-9-]+)', 1)).alias("lang"),
        F.array_sort(F.map_entries("source_headers")).alias("source"),
    )
    rows = rows.withColumn("text", characters(F.col("bare"))).withColumn("text", narrowed(F.col("text")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))     # noqa: E731
    about = F.concat(
        line("title", F.col("title")), line("language", F.col("lang")), line("characters", F.length("text").cast("string")),
        line("links", F.size("links").cast("string")), F.array_join(F.transform("links", lambda u: line("outlink", characters(u))), ""),
        F.coalesce(F.array_join(F.transform("source", lambda e: F.concat(F.lit("source-"), e["key"], F.lit(": "), F.coalesce(e["value"], empty), F.lit(END))), ""), empty),
    )
    made = F.explode(F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("content_type"), about.alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )).alias("made")
    rows = rows.select(*carry, "refers_to", "target_uri", "date", "source_digest", made)
    rows = rows.select(*carry, "refers_to", "target_uri", "date", "source_digest", "made.*")
    rows = rows.select(
        *carry, "kind", record_id(F.col("kind"), F.col("refers_to"), F.col("target_uri"), F.col("date")).alias("record_id"),
        "refers_to", "target_uri", "date", "content_type", F.octet_length("block").cast("long").alias("content_length"),
        digest(F.col("block")).alias("block_digest"), "source_digest", "block",
    )
    header = F.concat(
        F.lit("WARC/1.1" + END), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Refers-To-Payload-Digest", F.col("source_digest")),
        line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    return rows.withColumn("header", header)


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response rows for a table of pages (page_id, url, html): ids made from page id and URL."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "url")]
    return pages.select(
        "page_id", record_id(F.lit("response"), *parts).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8")).alias("headers"), F.col("html").alias("payload"),
    )


def write_records(records: DataFrame, path: str) -> None:
    """Write derived records as WARC files: header, empty line, block, two line ends."""
    text = F.concat("header", F.lit(END), "block", F.lit(END))
    records.select(text.alias("value")).write.option("lineSep", END).text(path)
