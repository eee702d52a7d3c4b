"""The operators' named queries, each over its whole table, and SQL where SQL can do it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpress.catalog.registry import table
from docpress.llm.collocations import collocations
from docpress.llm.common import stored
from docpress.llm.conversations import conversation_reports, repaired_turns
from docpress.llm.decontamination import contaminated
from docpress.llm.jaccard import jaccard_components
from docpress.llm.language import fit, identify_languages
from docpress.llm.licenses import scan_licenses
from docpress.llm.lines import drop_repeated_lines
from docpress.llm.packing import pack_documents
from docpress.llm.pii import find_personal_data
from docpress.llm.sharding import shard_documents
from docpress.llm.simhash import simhash_components
from docpress.llm.sketches import as_text, edited_fingerprints
from docpress.llm.substrings import drop_repeated_windows

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function
    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op2_licenses")
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    names = F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"])))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(names, ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op3_line_dedup", sql=f"""
    with lines as (
        select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
        from documents),
    keyed as (
        select doc_id, line, pos,
               trim(translate(line, '{_UPPER}', '{_LOWER}'),
                    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line_key
        from lines),
    owners as (
        select line_key, min(doc_id) as owner from keyed where length(line_key) >= 10
        group by line_key)
    select doc_id, count(*)::bigint as n_lines,
           (count(*) filter (where owner < doc_id))::bigint as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by pos)
                  filter (where owner is null or owner >= doc_id), '')) as kept_sha256
    from keyed left join owners using (line_key)
    group by doc_id
""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")),
        F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next", "next_id")


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables of texts: documents with their declarations, pages with addresses too."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents)
    texts = identify_languages(documents, model, declared_col="lang", host_col="source")
    pages = identify_languages(table(spark, sf_dir, "pages"), model, id_col="page_id",
                               text_col="html", url_col="url", html=True)
    none = F.lit(None).cast("long")
    return texts.withColumn("page_id", none).unionByName(
        pages.withColumnRenamed("doc_id", "page_id").withColumn("doc_id", none))


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_windows(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


@query("op11_jaccard_join")
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


_GRAMS_SQL = " union all ".join(f"""
        select lang, {n} as words, array_to_string(w[i:i + {n - 1}], ' ') as phrase, count(*) as f
        from (select lang, w, unnest(range(1, len(w) - {n - 2})) as i from pieces)
        group by 1, 2, 3""" for n in range(1, 5))


@query("op12_collocations", sql=f"""
    with split as (
        select coalesce(lang, 'und') as lang, unnest(string_split(
            translate(coalesce(text, ''), '{_UPPER}.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
                      '{_LOWER}' || repeat(chr(10), 9) || ' '), chr(10))) as piece
        from documents),
    pieces as materialized (
        select lang, list_filter(string_split(piece, ' '), lambda x: x <> '') as w from split),
    counts as materialized ({_GRAMS_SQL}),
    totals as (select lang, sum(f)::bigint as n from counts where words = 1 group by 1),
    candidates as materialized (
        select lang, words, phrase, f as a, string_split(phrase, ' ') as w from counts
        where words > 1 and f >= 30),
    lefts as materialized (
        select c.*, l.f as l, array_to_string(w[k + 1:], ' ') as rest
        from (select *, unnest(range(1, words)) as k from candidates) c
        join counts l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.k], ' ')),
    cuts as (
        select c.lang, c.phrase, c.words, c.a, c.k, c.l, r.f as r,
               (2000000::hugeint * c.a // (c.l + r.f))::bigint as score
        from lefts c join counts r on r.lang = c.lang and r.phrase = c.rest),
    scored as (
        select * from cuts
        qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    inner_phrases as (
        select lang, array_to_string(w[i:i + len - 1], ' ') as phrase, max(a) as longest
        from (select *, unnest(range(1, words - len + 2)) as i
              from (select *, unnest(range(2, words)) as len from candidates))
        group by 1, 2),
    ranked as (
        select s.*, row_number() over (
            partition by s.lang order by s.score desc, s.a desc, s.phrase) as rank
        from scored s left join inner_phrases i using (lang, phrase)
        where not coalesce(100::hugeint * longest >= 80::hugeint * s.a, false))
    select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score
    from ranked join totals using (lang) where rank <= 2000
""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by a checksum of conversation and turn."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")) % 20
    text = filled("text")
    return rows.select("conv_id", "turn", filled("role").alias("role"), text.alias("text"),
                       kind.alias("kind")).where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")
    ).drop("copy")


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are damaged first; each original one has a row."""
    rows = table(spark, sf_dir, "conversations")
    faulty = damaged(rows)
    reports = stored(conversation_reports(faulty), "conversation-reports")
    digests = repaired_turns(faulty, reports).where("sha256 is not null").select(
        F.col("conv").alias("mended"), "sha256")
    found = reports.join(digests, F.col("conv").eqNullSafe(F.col("mended")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select("conv_id").distinct().join(
        found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
