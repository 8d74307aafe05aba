"""Query of the conversation repair: the conversations with known damage."""

from pyspark.sql import functions as F

from .registry import case, table
from .turns import repair


def damaged(rows):
    """Rows with nulls as one space, some of them dropped, emptied, cut off, repeated or given to the user, by a checksum."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(name) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(0), F.lit(1)))
                  .otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


@case("op13_conversation_repair", r"""
    WITH RECURSIVE named AS (SELECT *, row_number() OVER () AS row, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' ||
            coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
      crc AS (SELECT row, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
            string_split(name, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 20 AS f FROM named),
      hurt AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
            CASE f WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
            unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM named JOIN crc USING (row)),
      placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
            rtrim(text, E' \t\n\x0b\x0c\r') AS solid FROM hurt),
      faulty AS (SELECT *, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before, CASE
            WHEN solid = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
            WHEN solid[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
      counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
            count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
            count(*) FILTER (fault = 't') AS truncated,
            count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY 1),
      -- scripts of each length: up to two insertions of the next role, then one edit of the next row
      ins(state, k, next, edits, lines, cost) AS (VALUES (0, 0, 0, '', []::VARCHAR[], 0), (1, 0, 1, '', [], 0), (2, 0, 2, '', [], 0),
            (3, 0, 3, '', [], 0), (0, 1, 2, 'I', ['user:'], 2), (1, 1, 2, 'I', ['user:'], 2), (2, 1, 3, 'I', ['assistant:'], 2),
            (3, 1, 2, 'I', ['user:'], 2), (0, 2, 3, 'II', ['user:', 'assistant:'], 4), (1, 2, 3, 'II', ['user:', 'assistant:'], 4)),
      keep(state, initial, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
      put(state, next, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
      walk(conv_id, pos, state, cost, audit, lines) AS (
        SELECT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM counted
        UNION ALL
        SELECT conv_id, pos, state, cost, audit, lines FROM (
          SELECT w.conv_id, f.pos, e.next AS state, w.cost + i.cost + e.cost AS cost, w.audit || i.edits || e.edit AS audit,
              w.lines || i.lines || e.lines AS lines
          FROM walk w JOIN ins i ON i.state = w.state
          JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1,
          LATERAL (SELECT 'D' AS edit, i.next AS next, 3 AS cost, []::VARCHAR[] AS lines
            UNION ALL SELECT 'K', k.next, (f.fault = 't')::INT, [f.role || ':' || f.text] FROM keep k
              WHERE k.state = i.next AND k.initial = f.initial AND f.fault NOT IN ('b', 'd')
            UNION ALL SELECT 'R', p.next, 2 + (f.fault = 't')::INT, [p.role || ':' || f.text] FROM put p
              WHERE p.state = i.next AND f.fault NOT IN ('b', 'd')) e)
        QUALIFY row_number() OVER (PARTITION BY conv_id, pos, state ORDER BY cost, audit) = 1),
      done AS (SELECT w.conv_id, w.cost + i.cost AS cost, w.audit || i.edits AS audit, w.lines || i.lines AS lines
        FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.pos
        JOIN ins i ON i.state = w.state AND i.next IN (0, 3)
        QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + i.cost, w.audit || i.edits) = 1)
    SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
      coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id""")
def op13_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    found = repair(damaged(rows)).withColumnRenamed("conv_id", "_conv")
    nothing = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
               "repaired_sha256": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}  # the hash of no bytes
    every = rows.select("conv_id").distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[F.coalesce(F.col(n), F.lit(v).cast("bigint") if v == 0 else F.lit(v)).alias(n) for n, v in nothing.items()])
