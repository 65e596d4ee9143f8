"""SQL for the results of decontamination, the dataset manifest and conversation repair."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def contamination_sql(words: int = 10) -> str:
    """Windows of items joined with runs of as many words of documents."""
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH item_words AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {split} AS w FROM benchmark),
    windows AS (
      SELECT DISTINCT item, least({words}, len(w)) AS n, array_to_string(w[i:i + least({words}, len(w)) - 1], ' ') AS s
      FROM item_words, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) t(i) WHERE len(w) > 0),
    lengths AS (SELECT DISTINCT n FROM windows),
    texts AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
    places AS (
      SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
      FROM texts, lengths, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i)),
    hits AS (SELECT r, i, places.n, item FROM places JOIN windows ON places.n = windows.n AND places.s = windows.s),
    covered AS (
      SELECT r, count(DISTINCT p) AS n_hit
      FROM (SELECT DISTINCT r, i, n FROM hits), unnest(range(i, i + n)) t(p) GROUP BY r),
    found AS (
      SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM texts LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
    """


# crc32 of ASCII text, by its table of 256 entries, which is computed here.
_CRC_TABLE = """list_transform(range(256), lambda b: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b))"""


def crc32_sql(text: str) -> str:
    """Needs a relation ``crc`` with the column ``entries`` in scope."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def manifest_sql(fanout: int = 8, levels: int = 7, top_levels: int = 4) -> str:
    """Levels one after the other, for at most ``fanout**levels`` rows a group and ``fanout**top_levels`` groups."""
    def part(cell: str) -> str:
        return f"coalesce(strlen(CAST({cell} AS VARCHAR)) || ':' || CAST({cell} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def level(source: str, key: str) -> str:
        """Node i of each tree of the next level; a lone node goes up as it is."""
        return f"""SELECT {key}, i // {fanout} AS i,
          CASE WHEN any_value(total) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
          FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS total FROM {source}) GROUP BY {key}, i // {fanout}"""

    ctes = [
        f"crc AS (SELECT {_CRC_TABLE} AS entries)",
        "langs AS (SELECT lang AS name, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents))",
        f"""hashed AS (SELECT row_number() OVER () AS r, doc_id, g, {leaf('text')} AS h,
          CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {leaf('text')} END AS other
          FROM documents JOIN langs ON lang IS NOT DISTINCT FROM name, crc)""",
        "l0 AS (SELECT r, doc_id, g, h, other, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM hashed)",
    ]
    ctes += [f"l{k + 1} AS ({level(f'l{k}', 'g')})" for k in range(levels)]
    ctes += [f"t0 AS (SELECT 0 AS z, g AS i, h FROM l{levels})"]
    ctes += [f"t{k + 1} AS ({level(f't{k}', 'z')})" for k in range(top_levels)]

    def sided(source: str, key: str) -> str:
        """Every node of a level with its siblings, by one window over its run."""
        run = f"PARTITION BY {key}, i // {fanout} ORDER BY i ROWS BETWEEN"
        return f"""SELECT {key}, i, count(*) OVER (PARTITION BY {key}) > 1 AS real,
          coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
          coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {source}"""

    ctes += [f"s{k} AS ({sided(f'l{k}', 'g')})" for k in range(levels)]
    ctes += [f"u{k} AS ({sided(f't{k}', 'z')})" for k in range(top_levels)]
    names = [f"s{k}" for k in range(levels)] + [f"u{k}" for k in range(top_levels)]
    joins = "".join(f" JOIN s{k} ON s{k}.g = l0.g AND s{k}.i = l0.i // {fanout**k}" for k in range(levels))
    joins += "".join(f" JOIN u{k} ON u{k}.i = l0.g // {fanout**k}" for k in range(top_levels))
    siblings = " || ".join(f"CASE WHEN {n}.real THEN {n}.before || {n}.after ELSE '' END" for n in names)
    ctes.append(f"""f0 AS (SELECT l0.doc_id, l0.h AS leaf, l0.other AS h, l0.g, sha256({siblings}) AS proof_sha256,
      {', '.join(f'{n}.real AS {n}r, {n}.before AS {n}b, {n}.after AS {n}a' for n in names)} FROM l0{joins})""")
    for k, n in enumerate(names):
        ctes.append(f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN {n}r THEN sha256({n}b || h || {n}a) ELSE h END AS h) FROM f{k})")
    return f"""
    WITH {', '.join(ctes)}
    SELECT doc_id, leaf, l{levels}.h AS subroot, t{top_levels}.h AS root, proof_sha256, f.h AS folded_root, f.h = t{top_levels}.h AS verified
    FROM f{len(names)} f JOIN l{levels} ON l{levels}.g = f.g, t{top_levels}
    """


def repair_sql() -> str:
    """Damage, faults, and the cheapest edits, turn by turn: least (cost, letters) of each state."""
    def edit(state: str, letter: str, cost: str, turn: str | None = None) -> str:
        text = f"{state}.t" if turn is None else f"{state}.t || {turn} || chr(10)"
        return f"CASE WHEN {state} IS NULL THEN NULL ELSE {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}} END"

    def insert(state: str, role: str) -> str:
        return edit(state, "I", "2", f"'{role}:'")

    def opened(source: str) -> str:
        """States after insertions: a third one would only come back to where it was."""
        return f"""SELECT *, least(u1, {insert('a2', 'user')}) AS u2 FROM (
            SELECT *, least(a0, {insert('u1', 'assistant')}) AS a2 FROM (
              SELECT *, least(u0, {insert('b0', 'user')}, {insert('s0', 'user')}, {insert('a0', 'user')}) AS u1 FROM {source}))"""

    def gone(state: str) -> str:
        return edit(state, "D", "3")

    def taken(state: str, role: str) -> str:
        """A turn kept where its initial is the role's, or given the role."""
        kept = f"CASE WHEN NOT must_go AND initial = '{role[0]}' THEN {edit(state, 'K', 'more', 'turn_text')} END"
        quoted = f"'{role}:' || body"
        return f"{kept}, CASE WHEN NOT must_go THEN {edit(state, 'R', '(2 + more)', quoted)} END"

    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    order = "ORDER BY turn NULLS FIRST, role, body, copy"
    user, helper = ", ".join(taken(state, "user") for state in ("b0", "s0", "a2")), taken("u2", "assistant")
    system = f"CASE WHEN NOT must_go AND initial = 's' THEN {edit('b0', 'K', 'more', 'turn_text')} END"
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
    return f"""
    WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS entries),
    drawn AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS body, {crc32_sql(key)} % 20 AS fault
      FROM conversations, crc),
    hurt AS (
      SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(body, '[.!?]', '', 'g') ELSE body END AS body, copy
      FROM drawn, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) t(copy) WHERE fault <> 0),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id {order}) AS n, substr(role, 1, 1) AS initial FROM hurt),
    marked AS (
      SELECT *, role || ':' || body AS turn_text, regexp_replace(body, '[\\x20\\x09-\\x0D]+$', '') AS bare,
             row_number() OVER (PARTITION BY conv_id, role, body ORDER BY n) > 1 AS again,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair
      FROM ordered),
    faulty AS (
      SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind
      FROM marked),
    steps AS (SELECT *, kind IN ('blank', 'duplicate') AS must_go, CASE WHEN kind = 'truncated' THEN 1 ELSE 0 END AS more FROM faulty),
    counts AS (
      SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE kind = 'blank') AS blank,
             count(*) FILTER (WHERE kind = 'duplicate') AS duplicate, count(*) FILTER (WHERE kind = 'truncated') AS truncated,
             count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS last
      FROM steps GROUP BY conv_id),
    paths AS (
      SELECT conv_id, 0 AS n, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS b0, {none} AS s0, {none} AS u0, {none} AS a0
      FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL
      SELECT conv_id, n + 1, {gone('b0')}, least({gone('s0')}, {system}), least({gone('u2')}, {user}), least({gone('a2')}, {helper})
      FROM (SELECT o.*, steps.* EXCLUDE (conv_id, n) FROM ({opened('paths')}) o
            JOIN steps ON steps.conv_id IS NOT DISTINCT FROM o.conv_id AND steps.n = o.n + 1)),
    ends AS (SELECT conv_id, n, least(b0, a2) AS best FROM ({opened('paths')}))
    SELECT ends.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
           sha256(regexp_replace(best.t, '\\n$', '')) AS repaired_sha256
    FROM ends LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ends.conv_id
    WHERE ends.n = coalesce(last, 0)
    """
