"""DuckDB oracles of the operators that SQL can express."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
_COMPONENTS = """
reach(a, b) AS (
  SELECT a, b FROM both_ways
  UNION
  SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"""

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS piece
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM w)
),
firsts AS (SELECT piece, min(doc_id) AS first FROM windows GROUP BY piece HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos
  FROM windows JOIN firsts USING (piece) WHERE first < doc_id
),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS body, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w) p
  ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

EMBEDDING_NEAR_DEDUP = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
both_ways AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
  ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.98
),
{_COMPONENTS},
links AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN links ON vec_id = links.a
"""

EXACT_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""

NGRAM_JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words FROM documents
),
grams AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[pos:pos + 3], ' ')) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS pos FROM w WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
linked AS (
  SELECT a, b FROM met JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * o >= 85 * (s.n + t.n - o)
),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
{_COMPONENTS}
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON w.doc_id = least.a
"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The rounds one after another, each over all parts and entries, in integers."""
    def nearest(name: str, books: str) -> str:
        return f"""
{name} AS MATERIALIZED (
  SELECT r, part, v, entry, d FROM (
    SELECT *, row_number() OVER (PARTITION BY r, part ORDER BY d, entry) AS place
    FROM (SELECT p.r, p.part, p.v, c.entry, CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
          FROM p JOIN {books} c ON p.part = c.part))
  WHERE place = 1
)"""

    def moved(name: str, books: str, near: str) -> str:
        return f"""
{name} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM {books} c LEFT JOIN (
    SELECT part, entry, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY pos) AS v FROM (
      SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n
      FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM {near}) GROUP BY part, entry, pos)
    GROUP BY part, entry) m ON c.part = m.part AND c.entry = m.entry
)"""

    steps = []
    for i in range(rounds):
        steps += [nearest(f"a{i}", f"c{i}"), moved(f"c{i + 1}", f"c{i}", f"a{i}")]
    steps.append(nearest("final", f"c{rounds}"))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS MATERIALIZED (
  SELECT r, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(part)
),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM p WHERE r <= {entries}),
{",".join(steps)},
books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS books FROM c{rounds}
),
coded AS (
  SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM final GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256
FROM coded JOIN kept USING (r), books
"""


# Every page of the tables has its main text in one article element, of paragraphs and a heading.
HTML_MAIN_TEXT = r"""
WITH blocks AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(p|h1)>') AS b FROM pages
),
texts AS (
  SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(
    regexp_replace(replace(replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))),
    lambda x: x <> '') AS t FROM blocks
)
SELECT page_id, url, array_to_string(t, chr(10)) AS text, CAST(length(array_to_string(t, chr(10))) AS BIGINT) AS n_chars FROM texts
"""


# Near words by a route of its own: two words of one length that are equal without the code point at one place, or one word
# that is the other without a code point.  crc32 is worked out bit by bit over the bytes of <doc_id>:<run>.
SPELLING_VARIANTS = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab
  FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))
),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) GROUP BY doc_id, run
),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
                                 lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) AS h
  FROM (SELECT run, n, hex(encode(doc_id || ':' || run)) AS x FROM runs), crc
),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
),
cuts AS MATERIALIZED (
  SELECT word, pos, word[1:pos] || word[pos + 2:] AS rest FROM (SELECT word, unnest(range(length(word))) AS pos FROM words)
),
near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.rest = b.word
),
ranked AS (
  SELECT near.word, other, w.n, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS place, count(*) OVER (PARTITION BY near.word) AS n_near
  FROM near JOIN words w ON w.word = other
),
formed AS MATERIALIZED (
  SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN r.n >= 10 * w.n THEN other END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1
),
followed(word, at_word, form) AS (
  SELECT word, word, form FROM formed
  UNION ALL
  SELECT f.word, g.word, g.form FROM followed f JOIN formed g ON f.form = g.word
)
SELECT f.word, f.n, f.n_near, f.form, CAST(f.form_n AS BIGINT) AS form_n, at_word AS root
FROM formed f JOIN followed l USING (word) WHERE l.form IS NULL
"""
