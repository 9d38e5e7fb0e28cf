"""Documents, versions, pages and fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.clean import clean_str, normalize_ws, strip
from factloom.operators.scaling import split_running_sum

# Quality limits of a parsed document, and the heading pattern (fixed values)
MIN_PAGE_CHARS = 40
MIN_TOTAL_CHARS = 120
MAX_BLANK_RATIO = 0.6
MIN_FRAGMENT_CHARS = 10
PARAGRAPH_BREAK = r"\n\s*\n|\n"
SECTION_HEADING = (
    r"^(第[一二三四五六七八九十百千0-9]+[章节部分]|[Cc]hapter\s+\d+|[Ss]ection\s+\d+|\d+(\.\d+)*\s*[、\.])"
)
MAX_FILE_BYTES = 50 * 1024 * 1024
DOWNLOAD_BUDGET = 3


def _or_none(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("None"))


def document_identity(catalog: DataFrame) -> DataFrame:
    """One document per source, external id and address; the last title wins."""
    key = F.sha2(
        F.concat_ws("|", _or_none(F.col("source_system")), _or_none(F.col("external_id")),
                    _or_none(F.col("source_url"))),
        256,
    )
    return (
        catalog.withColumn("document_id", key)
        .groupBy("document_id", "source_system", "external_id", "source_url")
        .agg(F.max_by("title", F.struct("seen_at", "title")).alias("title"))
    )


def version_documents(contents: DataFrame) -> DataFrame:
    """``contents(document_id, content_hash, seen_at)``; a known hash keeps its version."""
    first = contents.groupBy("document_id", "content_hash").agg(F.min("seen_at").alias("first_seen"))
    order = Window.partitionBy("document_id").orderBy("first_seen", "content_hash")
    return first.withColumn("version", F.row_number().over(order))


def provisional_hash(catalog: DataFrame) -> DataFrame:
    """D3: rows without a content hash get one from id and address."""
    made = F.sha2(F.concat_ws("|", _or_none(F.col("external_id")), _or_none(F.col("source_url"))), 256)
    return catalog.withColumn(
        "content_hash", F.coalesce(F.when(F.col("content_hash") != "", F.col("content_hash")), made)
    )


def page_quality(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Running offsets per page, and the parse verdict per document."""
    length = F.length("text")
    # Offsets need lengths alone; texts stay out of the shuffle, and a document
    # with very many pages is summed in runs of 1,000 pages
    sized = pages.select("document_id", "page_number", length.alias("chars"),
                         F.length(strip(F.col("text"))).alias("text_chars"))
    placed = split_running_sum(
        sized, ["document_id"], F.floor(F.col("page_number") / 1000), ["page_number"],
        {"char_end": F.col("chars")},
    ).withColumn("char_start", F.col("char_end") - F.col("chars"))
    blank = F.col("text_chars") < MIN_PAGE_CHARS
    ratio = F.col("blank_page_count") / F.col("page_count")
    docs = (
        sized.groupBy("document_id")
        .agg(
            F.count(F.lit(1)).alias("page_count"),
            F.sum("text_chars").alias("total_chars"),
            F.count_if(blank).alias("blank_page_count"),
        )
        .withColumn("blank_page_ratio", F.round(ratio, 3))
        .withColumn(
            "parse_status",
            F.when((F.col("total_chars") < MIN_TOTAL_CHARS) | (ratio > MAX_BLANK_RATIO),
                   "PARSE_NEEDS_REVIEW").otherwise("PARSED"),
        )
    )
    return placed.withColumn("blank", blank), docs


def segment_pages(pages: DataFrame) -> DataFrame:
    """Pages ``(document_id, page_number, text, char_start)`` to fragments.

    The split, the carried heading and the offsets are computed inside the row
    of a page, so no shuffle is needed and a long document spreads by its pages.
    The offset is that of the first occurrence on the page, hence a repeated
    paragraph yields one fragment. Offsets are searched in the generated rows, not
    in the array, so that a reader of texts alone does not search for them.
    """
    # A break of blank lines and a break of one line leave the same paragraphs with content
    lines = F.transform(F.split("text", "\n"), lambda p: F.struct(p.alias("para"), strip(p).alias("quote_text")))
    staged = pages.withColumn("_paras", F.filter(lines, lambda p: p["quote_text"] != "")).withColumn(
        "_heads",
        F.filter(
            F.transform("_paras", lambda p, i: F.when(p["quote_text"].rlike(SECTION_HEADING), i)),
            lambda i: i.isNotNull(),
        ),
    )

    def fragment(para: Column, index: Column) -> Column:
        head = F.array_max(F.filter("_heads", lambda i: i <= index))
        return F.struct(
            index.alias("paragraph_index"), para["para"].alias("para"), para["quote_text"].alias("quote_text"),
            F.substring(F.get("_paras", head)["quote_text"], 1, 80).alias("section_title"),
        )

    wanted = F.filter(F.transform("_paras", fragment), lambda x: F.length(x["quote_text"]) >= MIN_FRAGMENT_CHARS)
    rows = staged.select("document_id", "page_number", "char_start", "text", F.inline(wanted))
    # Within one step with the generator: only fragments leave the row of a page, not its text
    start = F.col("char_start") + F.position(F.col("para"), F.col("text")) - 1
    fragments = rows.select(
        "document_id", "page_number", "section_title", "paragraph_index",
        start.cast("int").alias("char_start"), (start + F.length("para")).cast("int").alias("char_end"),
        "quote_text", normalize_ws(F.col("quote_text")).alias("normalized_text"),
    )
    return fragments.withColumn("checksum", fragment_checksum())


def fragment_checksum() -> Column:
    """D6 key: page, start and normalised text."""
    return F.sha2(F.concat_ws("|", "page_number", "char_start", "normalized_text"), 256)


def dedup_fragments(fragments: DataFrame) -> DataFrame:
    """First fragment per (document, checksum)."""
    keys = ["document_id", "checksum"]
    rest = [c for c in fragments.columns if c not in keys]
    first = F.min_by(F.struct(*rest), "paragraph_index")
    return fragments.groupBy(*keys).agg(first.alias("s")).select(*keys, "s.*")


def admit_fragments(fragments: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents under review or failed yield no fragments."""
    parsed = docs.filter(F.col("parse_status") == "PARSED").select("document_id")
    return fragments.join(parsed, "document_id", "left_semi")


def latest_version(versions: DataFrame) -> DataFrame:
    """D8."""
    rest = [c for c in versions.columns if c not in ("document_id", "version")]
    return versions.groupBy("document_id").agg(
        F.max_by(F.struct("version", *rest), "version").alias("s")
    ).select("document_id", "s.*")


def list_evidence(fragments: DataFrame, document_id, limit: int = 100) -> DataFrame:
    """Fragments of one document in reading order."""
    return (
        fragments.filter(F.col("document_id") == document_id)
        .orderBy("page_number", "char_start", "checksum")
        .limit(limit)
    )


def reconcile_storage(versions: DataFrame, listing: DataFrame) -> DataFrame:
    """Stored keys without a file (to be fetched again) and files without a row."""
    known = versions.filter(F.col("storage_key").isNotNull()).select("storage_key")
    files = listing.select("storage_key")
    lost = versions.filter(
        (F.col("download_status") == "DOWNLOADED") & F.col("storage_key").isNotNull()
    ).select("storage_key")
    return (
        lost.join(files, "storage_key", "left_anti")
        .select("storage_key", F.lit("MISSING_FILE").alias("finding"),
                F.lit("DOWNLOAD_PENDING").alias("next_status"))
        .unionByName(
            files.join(known, "storage_key", "left_anti").select(
                "storage_key", F.lit("ORPHAN_FILE").alias("finding"),
                F.lit(None).cast("string").alias("next_status"),
            )
        )
        .distinct()
    )


def download_policy(files: DataFrame, allowed_hosts: list[str]) -> DataFrame:
    """``files(url, mime_type, size, head)``; first broken rule as ``rejected``."""
    scheme = F.expr("try_parse_url(url, 'PROTOCOL')")
    host = F.lower(F.coalesce(F.expr("try_parse_url(url, 'HOST')"), F.lit("")))
    reason = (
        F.when(F.coalesce(scheme, F.lit("")) != "https",
               F.concat(F.lit("non-https scheme rejected: "), F.coalesce(scheme, F.lit(""))))
        .when(~host.isin(allowed_hosts), F.concat(F.lit("domain not whitelisted: "), host))
        .when(F.col("size") > MAX_FILE_BYTES, "file too large")
        .when(~F.contains(F.lower("mime_type"), F.lit("pdf")), "unexpected mime type")
        .when(~F.contains(F.substring("head", 1, 1024), F.lit("%PDF-")), "magic bytes missing")
    )
    return files.withColumn("rejected", reason).withColumn("allowed", F.col("rejected").isNull())


def download_state(events: DataFrame, budget: int = DOWNLOAD_BUDGET) -> DataFrame:
    """Attempts and final status per version from its status events."""
    attempts = F.count_if(F.col("status") == "DOWNLOADING")
    last = F.max_by("status", F.struct("at", "event_id"))
    return (
        events.groupBy("version_id")
        .agg(attempts.alias("attempts"), last.alias("last_status"))
        .withColumn(
            "download_status",
            F.when(
                F.col("last_status").isin("DOWNLOADED", "DOWNLOAD_FAILED_FINAL"),
                F.col("last_status"),
            )
            .when(F.col("attempts") >= budget, "DOWNLOAD_FAILED_FINAL")
            .when(F.col("last_status") == "DOWNLOADING", "DOWNLOAD_FAILED_RETRYABLE")
            .otherwise(F.col("last_status")),
        )
    )


def document_freshness(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Newest download and number of versions per source."""
    per_document = versions.groupBy("document_id").agg(
        F.max("downloaded_at").alias("last"), F.count(F.lit(1)).alias("n")
    )
    return (
        docs.join(per_document, "document_id")
        .groupBy("source_system")
        .agg(F.max("last").alias("last_download_at"), F.sum("n").alias("downloaded_versions"))
    )


def profile_fragments(raw: DataFrame, companies: DataFrame) -> DataFrame:
    """Two profile texts per company become one document with up to two fragments."""
    texts = F.filter(
        F.array(*[clean_str(F.try_element_at("payload", F.lit(f)))
                  for f in ("introduction", "main_business")]),
        lambda t: t.isNotNull(),
    )
    code = F.try_element_at("payload", F.lit("ts_code"))
    rows = raw.select(code.alias("ts_code"), F.posexplode(texts).alias("index", "quote_text"))
    return rows.join(companies.select("ts_code", "company_id"), "ts_code").select(
        F.sha2(F.concat(F.lit("tushare:stock_company:"), "ts_code"), 256).alias("document_id"),
        "company_id",
        (F.col("index") + 1).alias("page_number"),
        F.lit(0).alias("char_start"),
        F.length("quote_text").alias("char_end"),
        "quote_text",
        F.sha2(F.concat_ws(":", F.lit("frag"), "ts_code", "index", "quote_text"), 256).alias("checksum"),
    )
