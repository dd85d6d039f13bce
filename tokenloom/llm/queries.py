"""The registered queries of this package, and SQL checks where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import table
from tokenloom.llm.merkle import manifest_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.drop("ids")


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op10_word_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.word_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, threshold=0.8)


@query
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@query
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.top_k import top_k

    return top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


SQL["op8_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


@query
def op6_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.quotes import link_replies, quoting_messages

    linked = link_replies(quoting_messages(table(spark, sf_dir, "conversations")))
    return linked.select("conv_id", "turn", "role", "text", "parent_turn", "root_turn", "depth", "position")


SQL["op6_quotation_links"] = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, role, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS text,
    trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS plain,
    lag(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) OVER w AS quoted,
    lag(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 2) OVER w AS quoted2
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), firsts AS (
  SELECT conv_id, plain, min(turn) AS turn FROM said WHERE plain <> '' GROUP BY conv_id, plain
), tree AS (
  SELECT s.conv_id, s.turn, s.role, s.text, coalesce(f.turn, g.turn) AS parent_turn
  FROM said s
  LEFT JOIN firsts f ON f.conv_id = s.conv_id AND f.plain = s.quoted AND f.turn < s.turn
  LEFT JOIN firsts g ON g.conv_id = s.conv_id AND g.plain = s.quoted2 AND g.turn < s.turn
), walk AS (
  SELECT conv_id, turn, turn AS root_turn, CAST(0 AS BIGINT) AS depth FROM tree WHERE parent_turn IS NULL
  UNION ALL
  SELECT t.conv_id, t.turn, w.root_turn, w.depth + 1
  FROM tree t JOIN walk w ON w.conv_id = t.conv_id AND w.turn = t.parent_turn
)
SELECT t.conv_id, t.turn, t.role, t.text, t.parent_turn, w.root_turn, w.depth,
  row_number() OVER (PARTITION BY t.conv_id ORDER BY w.root_turn, w.depth, t.turn) AS position
FROM tree t JOIN walk w ON w.conv_id = t.conv_id AND w.turn = t.turn
"""


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op5_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id, r.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""


@query
def op11_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.byte_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


SQL["op12_merkle_manifest"] = manifest_sql()


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenloom.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


SQL["op13_phrases"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), s AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
  FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, cut,
    CAST(2000000 * CAST(c.a AS HUGEINT) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_parts AS (
  SELECT lang, a AS longer, unnest(list_concat(
    CASE WHEN k > 2 THEN list_transform(range(1, k), lambda i: array_to_string(w[i:i + 1], ' ')) ELSE [] END,
    CASE WHEN k > 3 THEN list_transform(range(1, k - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [] END)) AS phrase
  FROM c
), cover AS (
  SELECT lang, phrase, max(longer) AS longer FROM inner_parts GROUP BY ALL
), kept AS (
  SELECT b.* FROM least b LEFT JOIN cover v ON v.lang = b.lang AND v.phrase = b.phrase
  WHERE v.longer IS NULL OR 100 * CAST(v.longer AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) WHERE rank <= 2000
"""
