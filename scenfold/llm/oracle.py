"""The registered queries as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from . import imatch, mixing, phrases, sharding

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"


def table_sql(table: list[int]) -> str:
    return f"[{','.join(map(str, table))}]"


def sharding_sql() -> str:
    names = sharding.shard_names()
    grown = sharding.shard_names(len(names) + 1)
    return f"""
    WITH placed AS (
        SELECT doc_id,
               ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT
                   % {sharding.SLOTS} AS slot
        FROM documents)
    SELECT doc_id, slot,
           ({table_sql(sharding.filled_table(names))})[slot + 1] AS shard,
           ({table_sql(sharding.filled_table(grown))})[slot + 1] AS shard_grown
    FROM placed"""


def mixing_sql() -> str:
    repeats = mixing.MAX_REPEATS
    return f"""
    WITH docs AS (
        SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
               md5('{mixing.SEED}' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS shuffled
        FROM documents),
    sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
    weighted AS (
        SELECT *, [{', '.join(map(str, mixing.WEIGHTS))}][
                   (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1
               ] AS weight,
               source_size * {repeats} AS cap
        FROM sizes),
    levels AS (
        SELECT *, cap / weight AS ratio,
               (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT
                   / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS level
        FROM weighted
        WINDOW before AS (ORDER BY cap / weight, source IS NOT NULL, source
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (
        SELECT source, source_size,
               CASE WHEN ratio <= level THEN cap::DOUBLE
                    ELSE weight * max(CASE WHEN ratio > level THEN level END) OVER () END AS target
        FROM levels),
    queue AS (
        SELECT d.*, t.source_size, t.target,
               (sum(size) OVER (PARTITION BY d.source ORDER BY shuffled, doc_id
                                ROWS UNBOUNDED PRECEDING))::BIGINT AS sent
        FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
    copies AS (
        SELECT doc_id, source, size, sent + r * source_size AS sent,
               least(floor((sent + r * source_size)::DOUBLE / target * {mixing.TICKS}),
                     {mixing.LAST_TICK})::BIGINT AS tick
        FROM queue, range({repeats}) AS repeats(r) WHERE size > 0),
    merged AS (
        SELECT doc_id, size, sum(size) OVER in_order AS upto, row_number() OVER in_order AS position
        FROM copies WINDOW in_order AS (ORDER BY tick, source IS NOT NULL, source, sent)),
    taken AS (
        SELECT doc_id, sum(size)::BIGINT AS taken, min(position) AS position FROM merged
        WHERE upto <= (SELECT sum(size) FROM docs) GROUP BY doc_id)
    SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) AS taken, t.position
    FROM queue q LEFT JOIN taken t USING (doc_id)"""


def imatch_sql() -> str:
    """The text is compared by code points; a subset's terms are in the order of their codes."""
    parts, j = [], 0
    for digits, chosen, subsets in imatch.RATES:
        for _ in range(subsets):
            parts.append(
                f"string_agg(CASE WHEN ('0x' || substr(md5('{j}:' || term), 1, {digits}))::INT"
                f" < {chosen} THEN code::VARCHAR END, ',' ORDER BY code)"
            )
            j += 1
    hashed = ", ".join(f"coalesce(substr(md5({p}), 1, 8), '{imatch.EMPTY}')" for p in parts)
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = rf"list_distinct(regexp_extract_all({lower}, '[^ \t\n\x0B\f\r]+'))"
    return rf"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    after AS (
        SELECT doc_id, text, length(text) AS n_chars,
               coalesce(lead(text) OVER (ORDER BY doc_id),
                        first_value(text) OVER (ORDER BY doc_id)) AS next_text,
               coalesce(lead(doc_id) OVER (ORDER BY doc_id),
                        first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id
        FROM docs),
    edits AS (
        SELECT *, substring(text, 1, n_chars - n_chars // 2)
                  || substring(next_text, 1, n_chars // 2) AS edited
        FROM after),
    band AS (
        SELECT term, ('0x' || substr(md5(term), 1, 7))::BIGINT AS code
        FROM (SELECT unnest({terms}) AS term FROM docs) GROUP BY term
        HAVING count(*) * {imatch.RARE} >= (SELECT count(*) FROM docs)
           AND count(*) * {imatch.COMMON} <= (SELECT count(*) FROM docs)),
    texts AS (
        SELECT doc_id, false AS is_edited, text FROM edits
        UNION ALL SELECT doc_id, true, edited FROM edits),
    found AS (
        SELECT doc_id, is_edited, [{hashed}] AS parts
        FROM (SELECT doc_id, is_edited, unnest({terms}) AS term FROM texts) JOIN band USING (term)
        GROUP BY doc_id, is_edited),
    prints AS (
        SELECT t.doc_id, t.is_edited,
               CASE WHEN f.parts IS NULL OR len(list_filter(f.parts, lambda x: x <> '{imatch.EMPTY}')) = 0
                    THEN list_transform(range({imatch.SUBSETS}), lambda x: substr(md5({lower}), 1, 8))
                    ELSE f.parts END AS parts
        FROM texts t LEFT JOIN found f
          ON t.doc_id = f.doc_id AND t.is_edited = f.is_edited),
    three AS (
        SELECT e.doc_id, n_chars, sha256(edited) AS edited_sha256,
               o.parts AS own, d.parts AS changed, n.parts AS other
        FROM edits e JOIN prints o ON o.doc_id = e.doc_id AND NOT o.is_edited
        JOIN prints d ON d.doc_id = e.doc_id AND d.is_edited
        JOIN prints n ON n.doc_id = e.next_id AND NOT n.is_edited),
    compared AS (
        SELECT *,
               len(list_filter(range(1, {imatch.SUBSETS} + 1), lambda i: own[i] = changed[i] AND own[i] <> '{imatch.EMPTY}')) AS same_changed,
               len(list_filter(range(1, {imatch.SUBSETS} + 1), lambda i: own[i] <> '{imatch.EMPTY}' OR changed[i] <> '{imatch.EMPTY}')) AS any_changed,
               len(list_filter(range(1, {imatch.SUBSETS} + 1), lambda i: own[i] = other[i] AND own[i] <> '{imatch.EMPTY}')) AS same_other,
               len(list_filter(range(1, {imatch.SUBSETS} + 1), lambda i: own[i] <> '{imatch.EMPTY}' OR other[i] <> '{imatch.EMPTY}')) AS any_other
        FROM three)
    SELECT doc_id, n_chars::BIGINT AS n_chars, edited_sha256,
           array_to_string(own, '') AS fingerprint,
           array_to_string(changed, '') AS edited_fingerprint,
           same_changed::DOUBLE / any_changed AS near_edited,
           same_other::DOUBLE / any_other AS near_next
    FROM compared"""


def merkle_sql() -> str:
    """Trees level by level; then every leaf's steps, folded in a second recursion."""
    def field(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(n_chars: str) -> str:
        fields = ("doc_id", "source", "lang", n_chars, "text")
        return f"sha256(concat({', '.join(field(f) for f in fields)}))"

    # CRC-32 of the id's digits, bit by bit: a byte comes as a number above 255, then eight shifts.
    crc = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
        range(1, length(CAST(doc_id AS VARCHAR)) + 1),
        lambda i: [256 + ascii(substr(CAST(doc_id AS VARCHAR), i, 1)), 0, 0, 0, 0, 0, 0, 0, 0]))),
        lambda x, y: CASE WHEN y > 255 THEN xor(x, y - 256)
                          WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295)"""
    return f"""
    WITH RECURSIVE leaves AS (
        SELECT *, coalesce('s' || lang, 'n') AS tree,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
               count(*) OVER (PARTITION BY lang) AS n
        FROM (SELECT doc_id, lang, {leaf("n_chars")} AS leaf,
                     CASE WHEN {crc} % 7 = 0 THEN {leaf("n_chars + 1")} ELSE {leaf("n_chars")} END AS checked
              FROM documents)),
    nodes AS (
        SELECT tree, lang, n, 0 AS level, pos, leaf AS h FROM leaves
        UNION ALL
        SELECT tree, any_value(lang), any_value(n), any_value(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
        FROM nodes WHERE (n - 1) >> level > 0 GROUP BY tree, pos // 2),
    subroots AS (
        SELECT tree, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
        FROM nodes WHERE (n - 1) >> level = 0),
    tops AS (
        SELECT n, 0 AS level, pos, h FROM subroots
        UNION ALL
        SELECT any_value(n), any_value(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
        FROM tops WHERE (n - 1) >> level > 0 GROUP BY pos // 2),
    steps AS (
        SELECT l.tree, l.pos, x.level, l.pos >> x.level & 1 = 1 AS is_right, coalesce(s.h, '') AS h
        FROM leaves l JOIN range(64) AS x(level) ON (l.n - 1) >> x.level > 0
        LEFT JOIN nodes s ON s.tree = l.tree AND s.level = x.level AND s.pos = xor(l.pos >> x.level, 1::BIGINT)
        UNION ALL
        SELECT l.tree, l.pos, 100 + x.level, r.pos >> x.level & 1 = 1, coalesce(s.h, '')
        FROM leaves l JOIN subroots r ON r.tree = l.tree JOIN range(64) AS x(level) ON (r.n - 1) >> x.level > 0
        LEFT JOIN tops s ON s.level = x.level AND s.pos = xor(r.pos >> x.level, 1::BIGINT)),
    listed AS (
        SELECT tree, pos, list({{'r': is_right, 'h': h}} ORDER BY level) AS path,
               sha256(string_agg(h, '' ORDER BY level)) AS proof_sha256
        FROM steps GROUP BY tree, pos),
    folding AS (
        SELECT l.tree, l.pos, 0 AS done, checked AS h, coalesce(path, []) AS path
        FROM leaves l LEFT JOIN listed p ON p.tree = l.tree AND p.pos = l.pos
        UNION ALL
        SELECT tree, pos, done + 1,
               sha256(CASE WHEN path[done + 1].r THEN path[done + 1].h || h ELSE h || path[done + 1].h END), path
        FROM folding WHERE done < len(path))
    SELECT l.doc_id, l.leaf, r.h AS subroot, t.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
           f.h AS folded_root, f.h = t.h AS verified
    FROM leaves l JOIN subroots r ON r.tree = l.tree
    JOIN (SELECT h FROM tops WHERE (n - 1) >> level = 0) t ON true
    LEFT JOIN listed p ON p.tree = l.tree AND p.pos = l.pos
    JOIN folding f ON f.tree = l.tree AND f.pos = l.pos AND f.done = len(f.path)"""


def phrases_sql() -> str:
    least, most = phrases.MIN_COUNT, phrases.MAX_WORDS
    return rf"""
    WITH pieces AS (
        SELECT coalesce(lang, '{phrases.NO_GROUP}') AS lang,
               regexp_extract_all(unnest(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[.,;:!?

]')), '[^ 	]+') AS w
        FROM documents),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    grams AS (
        SELECT lang, words, array_to_string(gram, ' ') AS phrase, count(*) AS f
        FROM (SELECT lang, k.words, unnest(list_transform(range(1, len(w) - k.words + 2),
                     lambda i: w[i:i + k.words - 1])) AS gram
              FROM pieces, range(1, {most + 1}) AS k(words) WHERE len(w) >= k.words)
        GROUP BY ALL HAVING count(*) >= {least}),
    phrases AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE words > 1),
    inner_ AS (
        SELECT p.lang, array_to_string(p.w[i.x:i.x + k.words - 1], ' ') AS phrase, max(f) AS around
        FROM phrases p, range(2, {most}) AS k(words), range(1, {most}) AS i(x)
        WHERE k.words < p.words AND i.x + k.words - 1 <= p.words GROUP BY ALL),
    cuts AS (
        SELECT p.lang, p.phrase, p.f AS a, k.k, h.f AS l, t.f AS r, n,
               ((1000::HUGEINT * p.f * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
        FROM phrases p LEFT JOIN inner_ o ON o.lang = p.lang AND o.phrase = p.phrase
        JOIN range(1, {most}) AS k(k) ON k.k < p.words
        JOIN grams h ON h.lang = p.lang AND h.phrase = array_to_string(p.w[1:k.k], ' ')
        JOIN grams t ON t.lang = p.lang AND t.phrase = array_to_string(p.w[k.k + 1:p.words], ' ')
        JOIN totals s ON s.lang = p.lang
        WHERE o.around IS NULL OR o.around < p.f),
    weakest AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
           phrase, a, l, r, n, score
    FROM weakest QUALIFY rank <= {phrases.TOP}"""


ORACLE: dict[str, str] = {
    "op7_imatch": imatch_sql(),
    "op8_sharding": sharding_sql(),
    "op10_mixing": mixing_sql(),
    "op12_merkle": merkle_sql(),
    "op13_collocations": phrases_sql(),
}
