"""DuckDB SQL of the longer checks."""

from __future__ import annotations

#: CRC-32 of an ASCII text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({0}, '.'), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""


def _after(state: str, cost: str, edit: str, line: str = "''") -> str:
    """The entry of a cell that follows ``state`` by one edit."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {state}.r || {line}}} END"


def _least(*entries: str) -> str:
    return f"list_min([{', '.join(entries)}])"


def _inserted(n: str, s: str, u: str, a: str) -> tuple[str, str]:
    """The user's and the assistant's cells after any number of insertions."""
    user = lambda x: _after(x, "5", "I", "chr(10) || 'user:'")
    both = lambda x: _after(x, "10", "II", "chr(10) || 'user:' || chr(10) || 'assistant:'")
    return (
        _least(u, user(n), user(s), user(a)),
        _least(a, _after(u, "5", "I", "chr(10) || 'assistant:'"), both(n), both(s)),
    )


def _conversation_repair() -> str:
    entry = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
    text = "chr(10) || {0} || ':' || text"
    keep = lambda x, letter: f"CASE WHEN fault IN ('sound', 'truncated') AND letter = '{letter}' THEN {_after(x, 'late', 'K', text.format('role'))} END"
    made = lambda x, role: f"CASE WHEN fault IN ('sound', 'truncated') THEN {_after(x, '1 + late', 'R', text.format(repr(role)))} END"
    gone = lambda x: _after(x, "2", "D")
    user, assistant = _inserted("n", "s", "u", "a")
    return rf"""
    WITH RECURSIVE raw AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
    dealt AS (SELECT *, {_CRC32.format("k")} % 20 AS kind FROM raw),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
      FROM dealt WHERE kind <> 0),
    placed AS (
      SELECT conv_id, turn, role, text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nth,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
        CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE ' ' END AS letter
      FROM damaged),
    judged AS (
      SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'sound' END AS fault,
        lag(letter) OVER (PARTITION BY conv_id ORDER BY nth) || letter AS pair
      FROM placed),
    counts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM judged GROUP BY 1),
    steps AS (SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late FROM judged),
    scan AS (
      SELECT conv_id, 0::BIGINT AS nth, {{'c': 0, 'a': '', 'r': ''}}::{entry} AS n, NULL::{entry} AS s, NULL::{entry} AS u, NULL::{entry} AS a
      FROM (SELECT DISTINCT conv_id FROM steps)
      UNION ALL
      SELECT conv_id, nth, {gone("n")}::{entry}, {_least(gone("s"), keep("n", "s"))}::{entry},
        {_least(gone("u"), *(made(x, "user") for x in "nsa"), *(keep(x, "u") for x in "nsa"))}::{entry},
        {_least(gone("a"), made("u", "assistant"), keep("u", "a"))}::{entry}
      FROM (
        SELECT t.conv_id, t.nth, t.role, t.text, t.letter, t.fault, t.late, n, s, {user} AS u, {assistant} AS a
        FROM scan JOIN steps t ON t.conv_id IS NOT DISTINCT FROM scan.conv_id AND t.nth = scan.nth + 1)),
    ends AS (
      SELECT conv_id, {_least("n", assistant)} AS best FROM scan
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY nth DESC) = 1)
    SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
      coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) g
    LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM g.conv_id
    LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM g.conv_id
    """


CONVERSATION_REPAIR = _conversation_repair()


HARD_NEGATIVES = """
    WITH v AS (
      SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS ints
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.i AS anchor, a.vec_id AS anchor_id, r.i AS other, r.vec_id, a.label = r.label AS alike,
        list_inner_product(a.ints, r.ints)::BIGINT AS score
      FROM v a JOIN v r ON a.i <> r.i WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, other FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, other) <= 5)
    SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor = s.anchor AND NOT s.alike AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
    WINDOW w AS (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.vec_id NULLS LAST, s.other)
    QUALIFY row_number() OVER w <= 5
    """
