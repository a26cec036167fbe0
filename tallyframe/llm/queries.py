"""One query per operator over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    ann, bpe, collocations, cross_tokenizer, embedding_dups, line_dedup, packing, pii, quality_ledger, simhash,
    token_files, toxicity, url_filter,
)
from tallyframe.llm.common import read, tokenizer_path
from tallyframe.session import configure

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            configure(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, {SPACE}), '{UPPER}', '{LOWER}') AS k FROM lines),
hot AS (SELECT k FROM (SELECT DISTINCT r, k FROM keyed WHERE k <> '') GROUP BY k HAVING count(*) >= 10),
marked AS (SELECT r, pos, line, hot.k IS NOT NULL AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked JOIN docs USING (r) GROUP BY r"""


@query("op1_line_dedup", OP1_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key is found in 10 documents or more, dropped everywhere."""
    return line_dedup.clean(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1, digest=True)


OP2_SQL = f"""
WITH heads AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM heads),
rules(verdict, rule, h, p) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
    ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
    ('block', 'com/de/', 'com', '/de/')),
hits AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hits USING (page_id)"""


@query("op2_url_filter", OP2_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's URL."""
    judged = url_filter.judge(read(spark, sf_dir, "pages"), url_filter.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents in doc_id order, read back."""
    return token_files.write_and_read(read(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), end_id=2)


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded, as digests."""
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), end_id=1, sequence=2048)


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document: 3-word shingles, 3 bits."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_embedding_dups")
def op3_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 or more, and groups, of all vectors."""
    return embedding_dups.near_duplicates(read(spark, sf_dir, "embeddings"), bound=0.9)


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced by pseudonyms, and their number."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, count="n_replaced")


@query("op8_ann")
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of each vector whose id is divisible by 100."""
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled rows of four folds."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


_WORD = "[^\\x20\\x09-\\x0D]"

#: Measurements as SQL says them: words and lines unnested, 8-word windows compared as texts.
MEASURES_SQL = f"""
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM
          (SELECT r, regexp_extract_all(text, '{_WORD}+') AS ws FROM docs)),
windows AS (SELECT r, pos, string_agg(w, ' ') OVER n8 AS g, count(*) OVER n8 AS k FROM words
            WINDOW n8 AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, g) AS n FROM windows WHERE k = 8) WHERE n > 1),
covered AS (SELECT r, count(*) AS n_repeat_words FROM
            (SELECT DISTINCT r, pos + d AS pos FROM twice, range(8) AS t(d)) GROUP BY r),
per_word AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars,
                    count(*) FILTER (WHERE regexp_matches(w, '\\p{{L}}')) AS n_alpha_words,
                    count(*) FILTER (WHERE regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS n_shout_words
             FROM words GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs),
per_line AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines,
                    count(*) FILTER (WHERE regexp_matches(l, '^[\\x20\\x09-\\x0D]*[-*\\x{{2022}}]')) AS n_bullet_lines,
                    count(*) FILTER (WHERE regexp_matches(l, '(\\.\\.\\.|\\x{{2026}})[\\x20\\x09-\\x0D]*$')) AS n_ellipsis_lines
             FROM lines WHERE regexp_matches(l, '{_WORD}') GROUP BY r),
measured AS (SELECT docs.r, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
                    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
                    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                    coalesce(n_alpha_words, 0) AS n_alpha_words, coalesce(n_shout_words, 0) AS n_shout_words,
                    coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines
             FROM docs LEFT JOIN per_word USING (r) LEFT JOIN per_line USING (r) LEFT JOIN covered USING (r)),
failing AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
                   [n_words < 20, 100 * n_repeat_words > 30 * n_words, n_words > 100000, word_chars < 3 * n_words,
                    word_chars > 10 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines,
                    10 * n_bullet_lines > 9 * n_lines, 10 * n_ellipsis_lines > 3 * n_lines, 10 * n_alpha_words < 8 * n_words,
                    2 * n_shout_words > n_words] AS bits FROM measured)"""

OP11_SQL = f"""WITH {MEASURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (bits[1] OR bits[2] OR bits[4] OR bits[5] OR bits[6] OR bits[7] OR bits[8] OR bits[9] OR bits[10] OR bits[11]) AS kept,
       list_sum(list_transform(range(1, 12), lambda i: CASE WHEN bits[i] THEN 1 << (i - 1) ELSE 0 END))::BIGINT AS failures
FROM failing"""


@query("op11_quality_rules", OP11_SQL)
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents, judged by the newest web policy."""
    entries = quality_ledger.ledger(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    judged = quality_ledger.judge(entries, quality_ledger.policy("web"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         quality_ledger.fails(quality_ledger.BASE).alias("base_failed"), "kept", "failures")


OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
                     translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
pieces AS (SELECT lang, r, unnest(ps) AS piece, unnest(range(len(ps))) AS p FROM
           (SELECT lang, r, regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]') AS ps FROM docs)),
words AS (SELECT lang, r, p, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM
          (SELECT lang, r, p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
runs AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
         FROM words WINDOW o AS (PARTITION BY r, p ORDER BY i)),
grams AS (SELECT lang, [w1] AS g FROM runs UNION ALL SELECT lang, [w1, w2] FROM runs WHERE w2 IS NOT NULL
          UNION ALL SELECT lang, [w1, w2, w3] FROM runs WHERE w3 IS NOT NULL
          UNION ALL SELECT lang, [w1, w2, w3, w4] FROM runs WHERE w4 IS NOT NULL
          UNION ALL SELECT lang, [w1, w2, w3, w4, w5] FROM runs WHERE w5 IS NOT NULL),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 100),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
scored AS (SELECT cuts.lang, cuts.g, cuts.a, k, x.a AS l, y.a AS r,
                  ((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score, n
           FROM cuts JOIN totals ON totals.lang = cuts.lang JOIN f x ON x.lang = cuts.lang AND x.g = cuts.g[1:k]
           JOIN f y ON y.lang = cuts.lang AND y.g = cuts.g[k + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
held AS (SELECT DISTINCT s.lang, s.g FROM f s JOIN
         (SELECT lang, a, len(g) AS size, g[i:j] AS inner_g FROM f, range(1, 6) AS t(i), range(1, 6) AS u(j)
          WHERE i < j AND j <= len(g) AND j - i + 1 < len(g)) big ON big.lang = s.lang AND big.inner_g = s.g
         WHERE 100 * big.a >= 100 * s.a),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM best ANTI JOIN held USING (lang, g))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
               FROM kept) WHERE rank <= 2000"""


@query("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of 2 to 5 words."""
    return collocations.collocations(read(spark, sf_dir, "documents"), min_count=100, max_words=5, top=2000)


@query("op13_cross_tokenizer")
def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids of two tokenizers, aligned and counted."""
    return cross_tokenizer.alignment(read(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), tokenizer_path(PIECES))
