"""SQL counterparts of the operators that SQL can express."""

from __future__ import annotations

from fluxlake.llm import chat, fill_middle, importance, mixing, quality_rules

SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALL_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

EXACT = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_replace(coalesce(text, ''), '{SPACE_CLASS}', '', 'g') AS p FROM documents),
k AS (SELECT doc_id, p, length(t) AS n_chars, first_value(doc_id) OVER (PARTITION BY p ORDER BY length(t) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY p) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(p) AS text_sha256, n_chars FROM k
"""


def _rules() -> str:
    def count_of(chars: str) -> str:
        return f"len(regexp_extract_all(t, '[{chars}]'))"

    def ratio(part: str, whole: str) -> str:
        return f"CASE WHEN {whole} > 0 THEN ({part}) / CAST({whole} AS DOUBLE) ELSE 0.0 END"

    stops = ", ".join(
        "len([x FOR x IN words IF lower(x) IN ({})])".format(", ".join(f"'{w}'" for w in listed))
        for listed in quality_rules.STOP_WORDS.values())
    stats = {
        "mean_word_chars": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"),
        "shout_ratio": ratio(count_of("!"), "n_words"), "capital_ratio": ratio(count_of("A-Z"), count_of("A-Za-z")),
        "stop_ratio": ratio(f"greatest({stops})", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "len(lines)"),
        "open_line_ratio": ratio(
            "len([x FOR x IN lines IF ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…')])", "len(lines)"),
        "bullet_line_ratio": ratio(
            "len([x FOR x IN lines IF ltrim(x, ' ')[1] IN ('-', '*', '•', '‣')])", "len(lines)"),
    }
    held = [f"{r.statistic} BETWEEN {r.lowest} AND {r.highest}" for r in quality_rules.RULES]
    reasons = " ".join(f"WHEN NOT ({h}) THEN '{r.statistic}'" for h, r in zip(held, quality_rules.RULES, strict=True))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT k, doc_id, t, regexp_extract_all(t, '{WORD_CLASS}') AS words,
             [x FOR x IN string_split(t, chr(10)) IF length(trim(x, {ALL_SPACES})) > 0] AS lines FROM d),
w AS (SELECT k, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM p),
x AS (SELECT k, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
y AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM x WHERE c IS NOT NULL),
z AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM y, (VALUES (0), (1), (2)) AS v(j) WHERE n > 1 GROUP BY k),
b AS (SELECT p.*, CAST(len(words) AS BIGINT) AS n_words,
             length(regexp_replace(t, '{SPACE_CLASS}', '', 'g')) AS word_chars,
             {count_of(quality_rules.SYMBOLS)} AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words FROM p LEFT JOIN z USING (k)),
s AS (SELECT *, n_words < {quality_rules.MIN_WORDS}
             OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
             {", ".join(f"{e} AS {n}" for n, e in stats.items())} FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(held)} AS kept,
       CASE WHEN base_failed THEN 'base' {reasons} END AS reason FROM s
"""


RULES = _rules()

CHAT = rf"""
WITH rows AS (
  SELECT conv_id, coalesce(turn, {chat.LAST_TURN}) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok'
  FROM (VALUES (0), (1)) AS v(i)),
printed AS (
  SELECT *, length(role) + length(text) + 15
         + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS chars FROM rows),
numbered AS (
  SELECT *, CAST(ceil(chars / 4.0) AS BIGINT) AS cost,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS number FROM printed),
led AS (
  SELECT *, number = 0 AND role = '{chat.SYSTEM}' AS leads,
         coalesce(max(CASE WHEN number = 0 AND role = '{chat.SYSTEM}' THEN cost END) OVER (PARTITION BY conv_id), 0) AS sys_cost,
         coalesce(max(CASE WHEN number = 0 AND role = '{chat.SYSTEM}' THEN chars END) OVER (PARTITION BY conv_id), 0) AS sys_chars,
         coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM numbered),
sized AS (
  SELECT *, greatest({chat.BUDGET} - sys_cost, 2) AS room,
         least({chat.HISTORY}, greatest({chat.BUDGET} - sys_cost, 2) // 2) AS recall,
         CASE WHEN leads THEN 0 ELSE earlier - sys_cost END AS start,
         CASE WHEN leads THEN 0 ELSE earlier - sys_cost + cost END AS stop FROM led),
placed AS (
  SELECT *, greatest(stop - 1, 0) // (room - recall) AS cell FROM sized),
owned AS (
  SELECT *, 2 * cell + CASE WHEN cell * (room - recall) - start > recall THEN 0 ELSE 1 END AS win FROM placed),
wins AS (
  SELECT conv_id, win, min(start) AS first_start, max(stop) AS last_stop, max(room) AS room, max(recall) AS recall,
         bool_or(leads) AS leads, max(sys_chars) AS sys_chars, sum(chars) AS own_chars FROM owned GROUP BY ALL),
backs AS (
  SELECT *, greatest(least(recall, room - (last_stop - first_start)), 0) AS back FROM wins),
shown AS (
  SELECT b.conv_id, b.win, any_value(b.own_chars) + CASE WHEN any_value(b.leads) THEN 0 ELSE any_value(b.sys_chars) END
         + coalesce(sum(o.chars), 0) AS chars
  FROM backs b LEFT JOIN owned o ON o.conv_id = b.conv_id AND NOT o.leads AND o.start < b.first_start
       AND o.start >= b.first_start - b.back GROUP BY b.conv_id, b.win),
totals AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM shown GROUP BY conv_id),
texts AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY number)) AS turns_sha256,
         coalesce(string_agg(CASE WHEN role = '{chat.TARGET}' THEN text ELSE '' END, '' ORDER BY number), '') AS loss
  FROM numbered GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM texts JOIN totals USING (conv_id)
"""


def _mix() -> str:
    n = len(mixing.WEIGHTS)
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    step = 1 / (len(mixing.SHAPES[0]) - 1)
    cases = []
    for rank, shape in enumerate(mixing.SHAPES):
        areas = [step * (a + b) / 2 for a, b in zip(shape, shape[1:], strict=False)]
        total = sum(areas)
        for k in reversed(range(len(areas))):
            before, low, high = sum(areas[:k]) / total, shape[k], shape[k + 1]
            rest = f"((share - {before}) * {total})"
            root = f"sqrt(greatest({low} * {low} + 2 * ({high} - {low}) * {rest} / {step}, 0.0))"
            cases.append(f"WHEN rank % {n} = {rank} AND share >= {before} THEN {k * step} + 2 * {rest} / ({low} + {root})")
    position = f"round(CASE {' '.join(cases)} END, 9)"
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_CLASS}')) AS BIGINT) AS size,
                  md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS code FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % {n} {weights} END AS weight FROM r),
l AS (SELECT *, ({mixing.PERCENT / 100} * sum(source_size) OVER ()
        - coalesce(sum({mixing.CAP} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY source_size / CAST(weight AS DOUBLE), rank)),
t AS (SELECT source, source_size, rank,
             least({float(mixing.CAP)} * source_size, max(level) OVER () * weight) AS target FROM l),
a AS (SELECT d.*, source_size, rank, target, CAST(floor(target + 0.5) AS BIGINT) AS goal,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY code, doc_id, size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, greatest(least(goal - place, size), 0) AS first_pass,
             greatest(least(goal - source_size - place, size), 0) AS second_pass,
             CASE WHEN goal > 0 THEN place / CAST(goal AS DOUBLE) END AS share,
             CASE WHEN goal > 0 THEN (source_size + place) / CAST(goal AS DOUBLE) END AS next_share FROM a)
SELECT doc_id, size, source_size, target, CAST(first_pass + second_pass AS BIGINT) AS taken,
       CAST((first_pass > 0) AS INT) + CAST((second_pass > 0) AS INT) AS n_passes,
       CASE WHEN first_pass > 0 THEN {position} END AS position,
       CASE WHEN second_pass > 0 THEN {position.replace('share', 'next_share')} WHEN first_pass > 0 THEN {position} END AS last_position FROM b
"""


MIX = _mix()

NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '{WORD_CLASS}') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
         THEN [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]
         WHEN len(words) > 0 THEN [array_to_string(words, ' ') || ' '] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT u, v FROM shared JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * m >= 75 * (x.n + y.n - m)),
sides AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS a, u AS b FROM sides UNION SELECT r.a, s.v FROM reach r JOIN sides s ON r.b = s.u),
low AS (SELECT a AS doc_id, min(b) AS found FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(found, w.doc_id) AS component_id,
       w.doc_id = coalesce(found, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.doc_id = w.doc_id
"""

IMPORTANCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '{PLAIN_WORD}') AS words FROM documents),
f AS (SELECT k, unnest(words) AS word FROM d),
g AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '{PLAIN_WORD}')) AS word FROM benchmark),
steps AS (
  SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS step
  FROM range(256) AS t(i)),
known AS (SELECT word, hex(encode(word)) AS code FROM (SELECT word FROM f UNION SELECT word FROM g)),
hashed AS (
  SELECT word, xor(list_reduce(
           [CAST('0x' || code[2 * i + 1:2 * i + 2] AS BIGINT) FOR i IN range(length(code) // 2)],
           lambda c, b: xor(c // 256, step[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % {importance.N_BUCKETS} AS bucket
  FROM known, steps),
s AS (SELECT bucket, count(*) AS s FROM f JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor({importance.SCALE} * ln(
           (coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + {importance.N_BUCKETS}.0::DOUBLE)
           / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM g) + {importance.N_BUCKETS}.0::DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT k, CAST(floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight FROM f JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY k),
x AS (
  SELECT d.k, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
  FROM d LEFT JOIN w ON w.k = d.k),
y AS (SELECT *, weight + CAST(floor(-{importance.SCALE} * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (
  SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
         {importance.DRAWN_PERCENT} * count(*) OVER () // 100 AS drawn FROM y WHERE n_features >= {importance.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM y LEFT JOIN z USING (k)
"""

FILL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
         sha256('{fill_middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS code FROM documents),
h AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n, CAST('0x' || code[1:8] AS BIGINT) % (len(tokens) + 1) AS a,
         CAST('0x' || code[9:16] AS BIGINT) % (len(tokens) + 1) AS b,
         CAST('0x' || code[17:24] AS BIGINT) AS h3, CAST('0x' || code[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT doc_id, t, n, coalesce(array_to_string(tokens[1:least(a, b)], ''), '') AS prefix,
         coalesce(array_to_string(tokens[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
         coalesce(array_to_string(tokens[greatest(a, b) + 1:], ''), '') AS suffix,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR h3 % 100 >= {fill_middle.TRANSFORMED_PERCENT} THEN 'plain'
              WHEN h4 % 100 < {fill_middle.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM c
"""
