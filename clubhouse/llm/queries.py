"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubhouse.llm import (
    collocations,
    language,
    lexical,
    merkle,
    mixing,
    nearcopies,
    pieces,
    quality,
    repeats,
    scoring,
    tokenfiles,
    vectors,
    warc,
)
from clubhouse.session import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors."""
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's piece ids and of their decoding."""
    rows = pieces.encode(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixed(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    rows = merkle.compared_with_next(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files, read them back, and say what is there."""
    path = _vocabulary("byte_bpe_50k.json")
    folder = shared_path(spark, "token-files")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = tokenfiles.write(
        docs, folder, lambda: tokenfiles.byte_level_encoder(path), width=2, end_id=2
    )
    return tokenfiles.read(manifest, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents."""
    return nearcopies.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated windows of words."""
    rows = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    one_space = F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " ")
    return rows.select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2(F.btrim(one_space, F.lit(" ")).cast("binary"), 256).alias("kept_sha256"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from the labels by co-training."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three parts in four."""
    docs = _table(spark, sf_dir, "documents")
    apart = language.held_out("doc_id", 4, 2)
    model = language.learn(docs.where(~apart).select("text", "lang"))
    return language.identify(docs, model).select("doc_id", apart.alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How probable every document is under models learnt from nine parts in ten."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    learnt = ~language.held_out("doc_id", 10, 0)
    path = _vocabulary("byte_bpe_50k.tiktoken")
    return scoring.score(docs, learnt, path, public_tokenizers.PATTERN)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every benchmark item."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n, total = lexical.statistics(docs)
    return lexical.search(lexical.index(docs, n, total), _table(spark, sf_dir, "benchmark"), n)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of every language whose words keep company."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as web archives, read them back, and say what is there."""
    folder = shared_path(spark, "archives")
    manifest = warc.write(_table(spark, sf_dir, "pages"), folder)
    records = warc.read(manifest, folder).where("record_type IN ('response', 'revisit')")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vectors": op1_vectors,
    "op2_pieces": op2_pieces,
    "op3_mixing": op3_mixing,
    "op4_fingerprints": op4_fingerprints,
    "op5_token_files": op5_token_files,
    "op6_near_copies": op6_near_copies,
    "op7_repeats": op7_repeats,
    "op8_quality": op8_quality,
    "op9_language": op9_language,
    "op10_scores": op10_scores,
    "op11_search": op11_search,
    "op12_phrases": op12_phrases,
    "op13_archives": op13_archives,
}

SQL: dict[str, str] = {
    "op1_vectors": r"""
WITH RECURSIVE given AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
good AS (
  SELECT vec_id, v FROM given
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reached(id, other) AS (
  SELECT vec_id, vec_id FROM given
  UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT g.vec_id, (SELECT count(*) FROM links l WHERE l.a = g.vec_id)::BIGINT AS n_links,
       m.component_id, g.vec_id = m.component_id AS kept
FROM given g JOIN (SELECT id, min(other) AS component_id FROM reached GROUP BY id) m ON m.id = g.vec_id
""",
    "op3_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, 'none')) AS order_key
  FROM documents),
sources AS (
  SELECT source, sum(size)::HUGEINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
limits AS (SELECT *, 3 * source_size AS most, 3 * source_size / weight AS ratio FROM sources),
levels AS (
  SELECT ratio,
         (SELECT sum(source_size) FROM limits)
           - coalesce((SELECT sum(b.most) FROM limits b WHERE b.ratio < a.ratio), 0) AS words,
         (SELECT sum(b.weight) FROM limits b WHERE b.ratio >= a.ratio) AS shares
  FROM (SELECT DISTINCT ratio FROM limits) a),
level AS (
  SELECT words::BIGINT AS words, shares::BIGINT AS shares FROM levels
  WHERE words <= ratio * shares ORDER BY ratio LIMIT 1),
targets AS (
  SELECT source, source_size::BIGINT AS source_size,
         CASE WHEN weight * words > most * shares THEN most::DOUBLE
              ELSE (weight * words)::DOUBLE / shares::DOUBLE END AS target
  FROM limits, level),
lined AS (
  SELECT s.*, sum(size) OVER (PARTITION BY source ORDER BY order_key, doc_id, size
                              ROWS UNBOUNDED PRECEDING) - size AS begun
  FROM sized s)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (floor(target + 0.5)::BIGINT // greatest(source_size, 1) * size
        + greatest(0, least(size, floor(target + 0.5)::BIGINT % greatest(source_size, 1) - begun)))::BIGINT AS taken
FROM lined JOIN targets t ON lined.source IS NOT DISTINCT FROM t.source
""",
    "op6_near_copies": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s
    FROM words WHERE len(w) >= 5
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
reached(id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
""",
    "op7_repeats": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
repeated AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM windows)
  WHERE k > 1),
covered AS (
  SELECT doc_id, list(DISTINCT p) AS gone
  FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM repeated) GROUP BY doc_id),
listed AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words),
places AS (SELECT DISTINCT doc_id, unnest(gone) AS p FROM covered),
kept AS (
  SELECT l.doc_id, string_agg(w[l.p], ' ' ORDER BY l.p) AS t
  FROM listed l ANTI JOIN places g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY l.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(c.gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM words d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
    "op11_search": r"""
WITH listed AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
stats AS (SELECT count(*) FILTER (len(t) > 0) AS nd, sum(len(t)) AS total FROM listed),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY 1, 2),
postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM listed)
  GROUP BY 1, 2, 3),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, stats GROUP BY term),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf)
           // (1000 * tf + 12 * (75 + ((25 * n::HUGEINT * nd) // total)))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), stats GROUP BY 1, 2)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
""",
    "op12_phrases": r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
counts AS (
  SELECT lang, p, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i+m-1])) AS p
    FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
  GROUP BY lang, p),
candidates AS (SELECT lang, p, f FROM counts WHERE len(p) >= 2 AND f >= 100),
inside AS (
  SELECT lang, sub, max(f) AS longer FROM (
    SELECT lang, f, p, unnest(list_transform(range(1, len(p) - m + 2), lambda i: p[i:i+m-1])) AS sub
    FROM candidates, (SELECT unnest(range(2, 5)) AS m) WHERE len(p) > m) GROUP BY lang, sub),
alone AS (
  SELECT c.* FROM candidates c LEFT JOIN inside i ON i.lang = c.lang AND i.sub = c.p
  WHERE longer IS NULL OR longer < f),
cuts AS (
  SELECT a.lang, a.p, a.f AS a, k, x.f AS l, y.f AS r, n,
         (1000::HUGEINT * a.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM alone) a JOIN totals t ON t.lang = a.lang
  JOIN counts x ON x.lang = a.lang AND x.p = a.p[1:k] JOIN counts y ON y.lang = a.lang AND y.p = a.p[k+1:]),
weakest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS place FROM cuts)
  WHERE place = 1),
ranked AS (
  SELECT *, array_to_string(p, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM weakest)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score FROM ranked WHERE rank <= 2000
""",
    "op13_archives": r"""
WITH paid AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
told AS (
  SELECT page_id, payload, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS smallest FROM paid)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = smallest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> smallest THEN smallest END AS refers_to
FROM told
""",
}
