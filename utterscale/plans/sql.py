"""SQL fragments shared by the checks: the fixtures and the text rules, for DuckDB."""

from __future__ import annotations

from utterscale.functions.text import FOLD_FROM, FOLD_TO

W = 24  # words of an utterance


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def tokens(text: str) -> str:
    return f"string_split(trim(regexp_replace({text}, '[ \t\n]+', ' ', 'g')), ' ')"


UTTERANCES = f"""
utt AS (
  SELECT doc_id * 1000000 + seg AS utt_id, doc_id, lang, source, t[seg * {W} + 1 : seg * {W} + {W}] AS tokens
  FROM (SELECT doc_id, lang, source, t, unnest(range(0, (len(t) + {W - 1}) // {W})) AS seg
        FROM (SELECT doc_id, lang, source, {tokens('text')} AS t FROM documents)))
"""

BENCHMARK_UTTERANCES = f"""
butt AS (
  SELECT -(item_id + 1) * 1000000 + seg AS utt_id, t[seg * {W} + 1 : seg * {W} + {W}] AS tokens
  FROM (SELECT item_id, t, unnest(range(0, (len(t) + {W - 1}) // {W})) AS seg
        FROM (SELECT item_id, {tokens('text')} AS t FROM benchmark)))
"""

PAIRS = """
pairs AS (
  SELECT 'A' AS system, utt_id, doc_id, lang, source, array_to_string(tokens, ' ') AS ref,
         CASE WHEN len(tokens) = 1 THEN '' ELSE array_to_string(list_transform(
           list_filter(tokens, lambda t, i: (i - 1) % 7 <> 3),
           lambda t, i: CASE WHEN (i - 1) % 11 = 5 THEN t || 'x' ELSE t END), ' ') END AS hyp
  FROM utt
  UNION ALL
  SELECT 'B', utt_id, doc_id, lang, source, array_to_string(tokens, ' '),
         coalesce(array_to_string(flatten(list_transform(list_filter(tokens, lambda t, i: (i - 1) % 5 <> 2),
           lambda t, i: CASE WHEN (i - 1) % 13 = 4 THEN [t, t] ELSE [t] END)), ' '), '')
  FROM utt)
"""

HYPS_REFS = """
hyps AS (
  SELECT system, utt_id, hyp FROM pairs WHERE system = 'A' OR source <> 'src3'
  UNION ALL SELECT 'A', utt_id, array_to_string(tokens, ' ') FROM butt),
refs AS (SELECT utt_id, lang, array_to_string(tokens, ' ') AS ref FROM utt)
"""

LABELS = """
lab AS (SELECT utt_id, doc_id, lower(array_to_string(tokens, ' ')) AS clear_text FROM utt)
"""

SIGNALS = f"""
{UTTERANCES.strip()},
sig AS (SELECT utt_id, list_transform(string_split(array_to_string(tokens, ' '), ''), lambda c: unicode(c)::FLOAT) AS input_values,
               list_transform(tokens, lambda t: length(t)::INT) AS labels
        FROM utt WHERE array_to_string(tokens, ' ') <> ''
        UNION ALL SELECT utt_id, [], [0] FROM utt WHERE array_to_string(tokens, ' ') = '')
"""

FRAMES = """
fr AS (SELECT vec_id AS utt_id, list_transform(range(0, 8), lambda k: embedding[k * 8 + 1 : k * 8 + 8]) AS frames
       FROM embeddings)
"""

FRAME_IDS = """
fid AS (SELECT vec_id AS utt_id,
               list_transform(embedding, lambda x: ((floor(x * 16)::INT % 4) + 4) % 4) AS ids FROM embeddings)
"""

TURNS = f"""
turns AS (SELECT conv_id * 1000 + turn AS utt_id, conv_id, role, {tokens('text')} AS tokens FROM conversations)
"""

ANNOTATED = """
ann AS (SELECT utt_id, conv_id, role, array_to_string(flatten(list_transform(tokens, lambda t, i: CASE
    WHEN (i - 1) % 13 = 5 THEN [t || '@!']
    WHEN (i - 1) % 17 = 3 THEN [t || '@g']
    WHEN (i - 1) % 19 = 7 THEN [t, '-', t]
    WHEN (i - 1) % 23 = 11 THEN [t || '@?']
    WHEN (i - 1) % 29 = 13 THEN ['@!', t]
    WHEN (i - 1) % 31 = 17 THEN [t, '--', t]
    WHEN (i - 1) % 37 = 19 THEN ['(...)', t]
    ELSE [t] END)), ' ') AS annotated FROM turns)
"""

PARSED = """
tok AS (SELECT utt_id, conv_id, role, i - 1 AS pos, ts[i] AS token
        FROM (SELECT utt_id, conv_id, role, ts, unnest(range(1, len(ts) + 1)) AS i
              FROM (SELECT utt_id, conv_id, role, list_filter(string_split(annotated, ' '), lambda w: w <> '') AS ts
                    FROM ann))),
par AS (SELECT utt_id, conv_id, role, pos,
    CASE WHEN token IN ('@!', '-', '--', '(...)', '(…)') THEN NULL
         WHEN regexp_matches(token, '(?s)^.+@[g?!][.,;:!?…]*$')
         THEN regexp_replace(token, '(?s)^(.+)@([g?!])([.,;:!?…]*)$', '\\1\\3') ELSE token END AS word,
    CASE token WHEN '@!' THEN 'missing' WHEN '-' THEN 'repetition' WHEN '--' THEN 'reformulation'
         WHEN '(...)' THEN 'pause' WHEN '(…)' THEN 'pause'
         ELSE CASE regexp_extract(token, '(?s)^(.+)@([g?!])([.,;:!?…]*)$', 2)
              WHEN 'g' THEN 'l1' WHEN '?' THEN 'guess' WHEN '!' THEN 'error' END END AS tag
    FROM tok)
"""

EVALS = """
evals AS (SELECT event_type || ':' || (user_id % 5) AS run, ts, event_id, value / 50 AS wer FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS eval_nr FROM evals)
"""

PAYLOADS = """
pay AS (SELECT event_id, event_type, '{"k": ' ||
    CASE event_type WHEN 'click' THEN '"' || k || '"' WHEN 'error' THEN k || '.5' WHEN 'purchase' THEN 'true'
         WHEN 'signup' THEN 'null' ELSE k END || ', "tags": ' ||
    CASE user_id % 3 WHEN 0 THEN '["' || event_type || '", 1]' WHEN 1 THEN '["' || event_type || '"]' ELSE '{}' END
    || ', "meta": ' || CASE WHEN user_id % 2 = 0 THEN '{"user": ' || user_id || '}' ELSE 'null' END
    || ', "name": "' || event_type || '"}' AS payload
  FROM (SELECT *, regexp_extract(props, ':\\s*(-?[0-9]+)', 1) AS k FROM events))
"""


def normalize(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(translate(replace(lower({x}), 'ß', 'ss'), "
            f"'{FOLD_FROM}', '{FOLD_TO}'), '[ \t]+', ' ', 'g'), '[^a-zäöü0-9 ]', '', 'g'), '[ \t]+', ' ', 'g'))")


def metric_text(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s\s+', ' ', 'g'))"


def metric_words(x: str) -> str:
    return f"list_filter(string_split({metric_text(x)}, ' '), lambda w: w <> '')"


def chars(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN [] ELSE string_split({x}, '') END"


def distance(a: str, b: str, items: str = "v") -> str:
    """Edit distance of two lists; ``items`` is the list of their distinct items.

    DuckDB compares bytes, so there may be 127 distinct items at most.
    """
    def code(x: str) -> str:
        return (f"coalesce(array_to_string(list_transform({x}, lambda w: chr(list_position({items}, w)::INT)), ''), '')")

    return f"levenshtein({code(a)}, {code(b)})::BIGINT"


def listed(name: str, keep: str, r: str, h: str, source: str, where: str = "true") -> str:
    """CTE with two lists ``r``, ``h`` and their distinct items ``v``."""
    return (f"{name} AS (SELECT *, list_distinct(list_concat(r, h)) AS v FROM "
            f"(SELECT {keep}, {r} AS r, {h} AS h FROM {source} WHERE {where}))")


def word_errors(source: str = "pairs", keep: str = "system, lang") -> str:
    """CTEs ``ww`` and ``we(keep, edits, ref_words)`` over pairs with a reference."""
    return (listed("ww", keep, metric_words("ref"), metric_words("hyp"), source, "ref <> ''") + ",\n"
            f"we AS (SELECT {keep}, {distance('r', 'h')} AS edits, len(r)::BIGINT AS ref_words FROM ww)")


def ngram_sums(source: str, by: str, hyp: str, refs: list[str], order: int = 4, char: bool = False,
               per_row: bool = False) -> str:
    """CTE ``ng(key, n, clipped)`` plus ``item``; ``source`` has a unique ``k``.

    Per n-gram: the hypothesis count, at most its highest count in one reference.
    """
    split = (lambda c: chars(c)) if char else (lambda c: f"string_split({c}, ' ')")
    cols = ", ".join(f"{split(r)} AS r{i}" for i, r in enumerate(refs))
    sep = "" if char else " "

    def grams(col: str) -> str:
        return (f"SELECT k, n, g, count(*) AS c FROM (SELECT k, n, unnest(list_transform("
                f"range(1, len({col}) - n + 2), lambda i: array_to_string({col}[i : i + n - 1], '{sep}'))) AS g "
                f"FROM item, (SELECT unnest(range(1, {order + 1})) AS n)) GROUP BY k, n, g")

    ref_grams = " UNION ALL ".join(f"({grams(f'r{i}')})" for i in range(len(refs)))
    ref_len = "r0" if len(refs) == 1 else None
    if ref_len:
        closest = "len(r0)"
    else:
        closest = ("CASE WHEN abs(len(r0) - len(h)) < abs(len(r1) - len(h)) THEN len(r0) "
                   "WHEN abs(len(r0) - len(h)) > abs(len(r1) - len(h)) THEN len(r1) ELSE least(len(r0), len(r1)) END")
    return f"""
item AS (SELECT k, {by}, {split(hyp)} AS h, {cols} FROM {source}),
hg AS ({grams('h')}),
rg AS (SELECT k, n, g, max(c) AS c FROM ({ref_grams}) GROUP BY k, n, g),
clip AS (SELECT hg.k, hg.n, sum(least(hg.c, rg.c))::BIGINT AS m FROM hg JOIN rg USING (k, n, g) GROUP BY hg.k, hg.n),
wide AS (SELECT item.k, {', '.join('item.' + b.strip() for b in by.split(','))}, len(h)::BIGINT AS hyp_len, ({closest})::BIGINT AS ref_len,
         {', '.join(f'coalesce(m{n}, 0) AS m{n}' for n in range(1, order + 1))},
         {', '.join(f'greatest(len(h) - {n - 1}, 1)::BIGINT AS p{n}' for n in range(1, order + 1))}
         FROM item LEFT JOIN (SELECT k, {', '.join(f'max(m) FILTER (n = {n}) AS m{n}' for n in range(1, order + 1))}
                              FROM clip GROUP BY k) c USING (k))
"""


def bleu_value(smoothing: float | None = None, order: int = 4) -> str:
    zero = "2.2250738585072014e-308" if smoothing is None else None
    logs = " + ".join(
        f"ln(CASE WHEN m{n} > 0 THEN m{n} / p{n} ELSE {zero or f'{smoothing}::DOUBLE / p{n}'} END) / {order}"
        for n in range(1, order + 1))
    return (f"CASE WHEN m1 > 0 AND hyp_len > 0 THEN (CASE WHEN hyp_len > ref_len THEN 1.0 "
            f"ELSE exp(1 - ref_len / hyp_len) END) * exp({logs}) ELSE 0.0 END")


def bleu_totals(by: str, order: int = 4) -> str:
    names = [f"{k}{n}" for k in "mp" for n in range(1, order + 1)] + ["hyp_len", "ref_len"]
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in names)
    return f"tot AS (SELECT {by}, count(*) AS n_pairs, {sums} FROM wide GROUP BY {by})"



def _words_below_hundred() -> str:
    units = ["", "ein", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"]
    first = ["", "eins", *units[2:], "zehn", "elf", "zwölf", "dreizehn", "vierzehn", "fünfzehn", "sechzehn",
             "siebzehn", "achtzehn", "neunzehn"]
    tens = ["zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig", "siebzig", "achtzig", "neunzig"]
    out = first + [f"{units[u]}und{t}" if u else t for t in tens for u in range(10)]
    return "[" + ", ".join(f"'{w}'" for w in out) + "]"


def _three(k: str) -> str:
    return (f"(CASE WHEN {k} >= 100 THEN ['ein','zwei','drei','vier','fünf','sechs','sieben','acht','neun']"
            f"[{k} // 100] || 'hundert' ELSE '' END || ({_words_below_hundred()})[{k} % 100 + 1])")


def cardinal(n: str) -> str:
    """German cardinal of a BIGINT expression below 10^18."""
    def named(power: int, one: str, many: str) -> str:
        k = f"(({n}) // {10 ** power} % 1000)"
        return f"CASE WHEN {k} = 0 THEN '' WHEN {k} = 1 THEN '{one} ' ELSE {_three(k)} || ' {many} ' END"

    t, u = f"(({n}) // 1000 % 1000)", f"(({n}) % 1000)"
    low = (f"CASE WHEN {t} = 0 THEN '' WHEN {t} = 1 THEN 'eintausend' ELSE {_three(t)} || 'tausend' END || "
           f"CASE WHEN {u} = 0 THEN '' ELSE {_three(u)} END")
    high = " || ".join(f"({named(p, o, m)})" for p, o, m in [
        (15, "eine Billiarde", "Billiarden"), (12, "eine Billion", "Billionen"),
        (9, "eine Milliarde", "Milliarden"), (6, "eine Million", "Millionen")])
    return f"(CASE WHEN ({n}) = 0 THEN 'null' ELSE trim({high} || {low}) END)"


def number_words(source: str, key: str, text: str) -> str:
    """CTE ``nw(key, spelled)``: number words for every row of ``source``.

    Covers integers, integer ordinals and dashed integers; other tokens are kept.
    """
    dash = "-–­"
    ordinal = ("CASE WHEN w LIKE '%eins' THEN w[:-5] || 'erste' WHEN w LIKE '%drei' THEN w[:-5] || 'dritte' "
               "WHEN w LIKE '%acht' THEN w || 'e' WHEN w LIKE '%sieben' THEN w[:-3] || 'te' "
               "WHEN regexp_matches(w, '(ig|ert|end)$') THEN w || 'ste' ELSE w || 'te' END")
    return f"""
nt AS (SELECT k0, unnest(range(1, len(ws) + 1)) AS i, ws FROM (
         SELECT {key} AS k0, string_split(trim(regexp_replace({text}, '[ \t]+', ' ', 'g')), ' ') AS ws FROM {source})),
nd AS (SELECT DISTINCT ws[i] AS tok FROM nt WHERE regexp_matches(ws[i], '[0-9]')),
nx AS (SELECT tok, regexp_matches(tok, '^[0-9]+\\.$') AS is_ord,
              CASE WHEN regexp_matches(tok, '^[0-9]+\\.?$') AND length(tok) < 19
                   THEN replace(tok, '.', '')::BIGINT END AS num,
              CASE WHEN NOT regexp_matches(tok, '^[0-9'',.]+$') THEN regexp_extract(tok, '([0-9]+)[{dash}]', 1) END AS d1
       FROM nd),
ny AS (SELECT tok, is_ord, num, CASE WHEN d1 <> '' THEN
              regexp_replace(tok, '[0-9]+([{dash}])', {cardinal("d1::BIGINT")} || '\\1') ELSE tok END AS t1 FROM nx),
nz AS (SELECT tok, is_ord, num, t1, CASE WHEN NOT regexp_matches(tok, '^[0-9'',.]+$')
              THEN regexp_extract(t1, '[{dash}]([0-9]+)', 1) END AS d2 FROM ny),
ns AS (SELECT tok, CASE
         WHEN num IS NOT NULL AND is_ord THEN (SELECT {ordinal} FROM (SELECT {cardinal('num')} AS w))
         WHEN num IS NOT NULL THEN {cardinal('num')}
         WHEN d2 <> '' THEN regexp_replace(t1, '([{dash}])[0-9]+', '\\1' || {cardinal("d2::BIGINT")})
         ELSE t1 END AS spelled FROM nz),
nw AS (SELECT k0, string_agg(coalesce(ns.spelled, ws[i]), ' ' ORDER BY i) AS spelled
       FROM nt LEFT JOIN ns ON ns.tok = ws[i] GROUP BY k0)
"""
