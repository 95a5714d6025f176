"""The queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import gif, hard_negatives, language_crf, mixing, perspectives, segmentations, simhash, suffix_levels, token_counts, topk, url_lists, warc, word_runs
from spanloom.llm.common import scratch, table, written


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all ``embeddings`` to every vector whose id 50 divides."""
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), scale=256)
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS terms
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.terms, c.terms), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.terms) = len(q.terms)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents``."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=1024)


LEVELS = ["domain", "language", "origin"]
#: The production mix: half of all tokens, German and Spanish raised, the first domain doubled.
MIX = mixing.Mix(weights={"domain": {"d0": 2, "d1": 1, "d2": 1, "d3": 1}, "language": {"en": 4, "de": 3, "es": 3, "fr": 2}}, share=0.5, max_epochs=2, seed=1)


def with_levels(docs: DataFrame, names: list[str] = LEVELS) -> DataFrame:
    """Domain (a group of sources), language and source of each document as the tree's levels."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    domain = F.when(number == "", "other").otherwise(F.concat(F.lit("d"), (number.cast("long") % 4).cast("string")))
    return docs.withColumns(dict(zip(names, (domain, F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))), strict=True)))


def mixed(docs: DataFrame, mix: mixing.Mix, has_token: Column, name: str) -> DataFrame:
    """``docs`` and how often the mix draws each document, as the column ``name``."""
    own = {level: f"\0{level}" for level in LEVELS}  # names that no document has
    levels = list(own.values())
    mix = replace(mix, weights={own[level]: weights for level, weights in mix.weights.items()})
    leveled = with_levels(docs, levels)
    slim = written(leveled.select("doc_id", *levels, mixing.word_count(F.col("text")).alias("n_tokens")), "mix-tokens")
    return mixing.copies(leveled, mixing.plan(slim, levels, mix), levels, mix, has_token, name=name).drop(*levels)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the production mix draws each of ``documents``."""
    docs = with_levels(table(spark, sf_dir, "documents"))
    slim = written(docs.select("doc_id", *LEVELS, mixing.word_count(F.col("text")).alias("n_tokens")), "mix-tokens")
    drawn = mixing.copies(slim, mixing.plan(slim, LEVELS, MIX), LEVELS, MIX, F.col("n_tokens") > 0)
    return drawn.select("doc_id", *LEVELS, "n_tokens", "copies")


def _level_sql(parent: list[str], child: str) -> str:
    """One level of the budget, from the table above_<n> to the next."""
    path = ", ".join([*parent, child])
    over = f"PARTITION BY {', '.join([*parent, '0'])}"
    weights = MIX.weights.get(child, {})
    weight = f"CASE {child} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"
    n = len(parent)
    return f"""
nodes_{n} AS (
  SELECT {path}, CAST(sum(supply) AS BIGINT) AS supply, CAST({weight} AS BIGINT) AS weight FROM leaves GROUP BY {path}
), level_{n} AS (
  SELECT {", ".join(f"s.{c}" for c in [*parent, child])}, s.supply, s.weight,
         CAST(a.budget - sum(s.supply) OVER o + s.supply AS DOUBLE) / CAST(sum(s.weight) OVER ({over.replace(" BY ", " BY ").replace(", ".join(parent), ", ".join(f"s.{c}" for c in parent)) if parent else over}) - sum(s.weight) OVER o + s.weight AS DOUBLE) AS level
  FROM nodes_{n} s JOIN above_{n} a {"USING (" + ", ".join(parent) + ")" if parent else "ON true"}
  WHERE s.weight > 0
  WINDOW o AS (PARTITION BY {", ".join([*(f"s.{c}" for c in parent), "0"])} ORDER BY CAST(s.supply AS DOUBLE) / s.weight, s.{child} ROWS UNBOUNDED PRECEDING)
), above_{n + 1} AS (
  SELECT {path}, least(supply, CAST(floor(max(level) OVER ({over}) * weight) AS BIGINT)) AS budget FROM level_{n}
)"""


OP3_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
         CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
              ELSE 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 AS VARCHAR) END AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORDS}')) AS BIGINT) AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, language, origin, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {MIX.max_epochs} AS BIGINT) AS supply
  FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0
), above_0 AS (
  SELECT CAST(floor(sum(tokens) * CAST({MIX.share} AS DOUBLE)) AS BIGINT) AS budget FROM leaves
), {",".join(_level_sql(LEVELS[:d], LEVELS[d]) for d in range(3))}, shares AS (
  SELECT l.domain, l.language, l.origin, a.budget // l.tokens AS epochs, a.budget % l.tokens AS rest
  FROM leaves l JOIN above_3 a USING (domain, language, origin)
), placed AS (
  SELECT d.*, s.epochs, s.rest, CAST('0x' || substr(md5('{MIX.seed}:' || CAST(s.epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {mixing.DIGITS}) AS BIGINT) AS place
  FROM docs d LEFT JOIN shares s USING (domain, language, origin)
), summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM placed
)
SELECT doc_id, domain, language, origin, n_tokens,
       CAST(CASE WHEN n_tokens > 0 AND epochs IS NOT NULL THEN epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS copies
FROM summed
"""


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored as a GIF, decoded again, with digests of both."""
    stored = gif.encode_payloads(table(spark, sf_dir, "documents"))
    read = gif.decode_media(stored, carry=("n_bytes",))
    bins = F.aggregate("frames.histogram", F.array_repeat(F.lit(0).cast("long"), gif.LEVELS**3 + 1), lambda a, h: F.zip_with(a, h, lambda x, y: x + y))
    grey = F.transform(F.sequence(F.lit(0), F.lit(gif.LEVELS - 1)), lambda v: F.element_at(bins, (v * (gif.LEVELS**2 + gif.LEVELS + 1) + 1).cast("int")))
    shown = F.element_at("frames", -1)
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("frames="), F.size("frames")), F.concat(F.lit("ms="), shown.start_ms + shown.delay_ms), F.concat(F.lit("grey="), F.array_join(grey, ","))).alias("feature"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` as a WARC record, written to archives and read back from them."""
    folder = scratch(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder, revisit_bytes=1_000, most_bytes=64 << 20)
    records = warc.read_archives(spark, manifest, folder, with_payload=False)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of every whole text of ``documents``, linked at two bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op7_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best sampled segmentations of every whole text of ``documents``, decoded and compared."""
    found = segmentations.sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), k=2)
    score = lambda c: F.round(c, 6).alias(c)
    return found.select("doc_id", "rank", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), score("log_prob"), score("perturbed"), score("log_inclusion"), "round_trip")


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` as each participant's dialogue has it."""
    turns = perspectives.render(table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "perspective", "position", "turn", "speaker", F.md5("segment").alias("segment_md5"), "start", "stop", "mask_start", "mask_stop")


OP9_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'
), rendered AS (
  SELECT t.conv_id, perspective, turn, speaker, text,
         CASE WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10) WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head
  FROM turns t JOIN people p USING (conv_id)
), segments AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM rendered
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM segments WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text)
)
SELECT conv_id, perspective, position, turn, speaker, md5(segment) AS segment_md5, stop - length(segment) AS start, stop,
       CASE WHEN speaker = perspective THEN length(head) END AS mask_start, CASE WHEN speaker = perspective THEN length(segment) END AS mask_stop
FROM placed
"""


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated block list made up from the hosts of ``pages``: some hosts, their domains and folders
    come and go on days that follow from their names."""
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    names = hosts.select(F.explode(F.array("host", F.concat("host", F.lit("/en/")), F.regexp_replace("host", r"^[^.]*\.", ""))).alias("pattern")).distinct()
    drawn = names.withColumn("n", F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 8), 16, 10).cast("long")).where("n % 3 <> 0")
    steps = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(a).alias("action")) for k, a in enumerate(("add", "remove", "add", "remove"))))
    turns = drawn.select("pattern", "n", F.inline(steps))
    day = (F.col("n") % 120 + F.col("k") * (20 + F.col("n") % 50)).cast("int")
    return turns.select((F.col("n") * 4 + F.col("k")).alias("entry_id"), F.lit("block").alias("list"), "pattern", "action", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("dated"))


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the list as of each capture of ``pages`` blocks it; a page's id gives its fetch day."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    return url_lists.evaluate(pages.withColumn("fetched", fetched), url_lists.intervals(list_entries(pages)))


OP10_SQL = r"""
WITH captures AS (
  SELECT DISTINCT page_id, url, CAST(DATE '2024-01-01' + CAST(((page_id % 365) + 365) % 365 AS INTEGER) AS DATE) AS fetched FROM pages
), hosts AS (
  SELECT DISTINCT lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host FROM pages
), names AS (
  SELECT DISTINCT unnest([host, host || '/en/', regexp_replace(host, '^[^.]*\.', '')]) AS pattern FROM hosts WHERE host <> ''
), drawn AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 8) AS BIGINT) AS n FROM names
), entries AS (
  SELECT pattern, n * 4 + k AS entry_id, CASE WHEN k % 2 = 0 THEN 'add' ELSE 'remove' END AS action,
         CAST(DATE '2024-01-01' + CAST(n % 120 + k * (20 + n % 50) AS INTEGER) AS DATE) AS dated
  FROM drawn, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE n % 3 <> 0
), ruled AS (
  SELECT *, lead(dated) OVER (PARTITION BY pattern ORDER BY dated, entry_id) AS valid_to FROM entries
), listed AS (
  SELECT pattern, dated AS valid_from, valid_to FROM ruled WHERE action = 'add' AND (valid_to IS NULL OR valid_to > dated)
), parts AS (
  SELECT *, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
         string_split(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS steps
  FROM captures
), asked AS (
  SELECT DISTINCT page_id, url, fetched, unnest(list_concat(
    [array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') FOR i IN range(1, len(string_split(host, '.')) + 1)],
    [host || array_to_string(list_slice(steps, 1, i), '/') || '/' FOR i IN range(2, len(steps))])) AS pattern
  FROM parts WHERE host <> ''
), met AS (
  SELECT page_id, url, fetched, 'block:' || pattern AS found FROM asked JOIN listed USING (pattern)
  WHERE fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)
)
SELECT c.page_id, c.url, c.fetched, count(found) > 0 AS blocked, count(found) AS matches,
       coalesce(string_agg(found, ',' ORDER BY found), '') AS patterns
FROM captures c LEFT JOIN met m ON m.page_id IS NOT DISTINCT FROM c.page_id AND m.url IS NOT DISTINCT FROM c.url AND m.fetched IS NOT DISTINCT FROM c.fetched
GROUP BY ALL
"""


def held_out(key: str = "doc_id") -> Column:
    """A third of the documents, by their ids' checksum, from which nothing is learned."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def language_model(docs: DataFrame) -> language_crf.Model:
    return language_crf.train(language_crf.training_rows(docs.where(~held_out())))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = language_crf.identify(docs, language_model(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def spun(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, by their ids' checksum, go round in their last words."""
    white = "[\\x20\\x09-\\x0D]+"
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), white), lambda w: w != "")
    given = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"), F.expr("h div 10").alias("g"))
    sized = given.withColumn("n", F.size("words")).withColumn("a", F.expr("g % nullif(n, 0)"))  # no words: null
    period = F.expr("1 + (n - a) div (3 + g % 8)")
    turned = F.transform(F.col("words"), lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return sized.withColumn("p", period).select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every whole text of ``documents``, a tenth of them spun."""
    found = word_runs.find_runs(spun(table(spark, sf_dir, "documents")), least_length=24, least_exponent=3)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = found.strongest
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.start.alias("start"),
        best.length.alias("length"),
        best.period.alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every vector whose id 100 divides."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.labelled_vectors(table(spark, sf_dir, "embeddings"), label=label, scale=256)
    return hard_negatives.mine(rows, rows.where("vec_id % 100 = 0"), positives=5, negatives=10, low=30, high=90)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS terms
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.terms, c.terms), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.terms) = len(a.terms)
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text of ``documents`` that strings of 400 bytes repeated anywhere cover."""
    found = suffix_levels.deduplicate(table(spark, sf_dir, "documents"), least=400)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_gif_media": op4_gif_media,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_segmentations": op7_segmentations,
    "op8_language_id": op8_language_id,
    "op9_perspectives": op9_perspectives,
    "op10_url_lists": op10_url_lists,
    "op11_word_runs": op11_word_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": OP1_SQL,
    "op3_mixing": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op9_perspectives": OP9_SQL,
    "op10_url_lists": OP10_SQL,
    "op12_hard_negatives": OP12_SQL,
}
