"""The same queries as plain SQL over the Parquet tables, for a second engine to check."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "units": """
        SELECT p_partkey AS unit_id, p_brand || '/' || p_type || '/part_' || p_partkey AS path,
               CASE WHEN p_type = 'PROMO' THEN 'test' ELSE 'source' END AS kind,
               CAST(floor(p_retailprice) AS BIGINT) AS bytes, sha256(p_name) AS hash,
               replace(p_name, ' ', '_') AS export, p_size AS max_cyclomatic,
               CASE WHEN p_size = 50 THEN 'too large to judge' END AS error
        FROM part""",
    "commits": """
        SELECT o_orderkey AS commit_id,
               'author_' || o_custkey
                 || CASE WHEN c_mktsegment = 'MACHINERY' THEN '[bot]' ELSE '' END AS author,
               strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS date,
               CAST(o_orderdate AS TIMESTAMP) >= (SELECT max(CAST(o_orderdate AS TIMESTAMP))
                 FROM orders) - INTERVAL 90 DAY AS recent,
               regexp_matches('author_' || o_custkey
                 || CASE WHEN c_mktsegment = 'MACHINERY' THEN '[bot]' ELSE '' END,
                 '\\[bot\\]|bot$|dependabot|renovate|github-actions', 'i') AS bot,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Revert the last order'
                 WHEN '2-HIGH' THEN 'fix: order entry' ELSE 'prefix the order' END AS subject
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "moments": """
        SELECT *, regexp_matches(subject,
                 '\\b(fix(es|ed)?|bug|hotfix|revert|regression|broken)\\b', 'i') AS bugfix,
               regexp_matches(subject, '\\brevert\\b', 'i') AS revert
        FROM commits""",
    "touches": """
        SELECT l.commit_id, u.path, m.author, m.date, m.recent, m.bot, m.bugfix, m.revert
        FROM (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS unit_id FROM lineitem) l
        JOIN moments m USING (commit_id) JOIN units u USING (unit_id)""",
    "churn": """
        SELECT path, count(*) AS commits, count_if(recent) AS recent_commits,
               count_if(bugfix) AS bug_fix_commits, count_if(revert) AS revert_commits,
               max(date) AS last_modified, min(date) AS first_seen
        FROM touches GROUP BY path""",
    "tally": """
        SELECT path, author, count(*) AS all_commits, count_if(recent) AS recent_commits
        FROM touches WHERE NOT bot GROUP BY path, author""",
    "authorship": """
        SELECT path, count(*) AS authors, count_if(recent_commits > 0) AS recent_authors,
               CASE WHEN sum(recent_commits) > 0
                 THEN CAST(max(recent_commits) AS DOUBLE) / CAST(sum(recent_commits) AS DOUBLE)
                 ELSE 0.0 END AS primary_author_share
        FROM tally GROUP BY path""",
    "small": """
        SELECT commit_id FROM touches GROUP BY commit_id HAVING count(*) BETWEEN 2 AND 25""",
    "pairs": """
        SELECT x.path AS a, y.path AS b, count(*) AS co_changes
        FROM touches x JOIN touches y ON x.commit_id = y.commit_id AND x.path < y.path
        WHERE x.commit_id IN (SELECT commit_id FROM small) GROUP BY 1, 2""",
    "small6": """
        SELECT commit_id FROM touches GROUP BY commit_id HAVING count(*) BETWEEN 2 AND 6""",
    "pairs6": """
        SELECT x.path AS a, y.path AS b, count(*) AS co_changes
        FROM touches x JOIN touches y ON x.commit_id = y.commit_id AND x.path < y.path
        WHERE x.commit_id IN (SELECT commit_id FROM small6) GROUP BY 1, 2""",
    "couplings": """
        SELECT a, b, co_changes,
               CAST(co_changes AS DOUBLE) / least(ca.commits, cb.commits) AS strength
        FROM pairs JOIN churn ca ON ca.path = a JOIN churn cb ON cb.path = b
        WHERE co_changes >= 2""",
    "directed": """
        SELECT a AS path, b AS other, co_changes, strength FROM couplings
        UNION ALL SELECT b, a, co_changes, strength FROM couplings""",
    "top": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path
                 ORDER BY strength DESC, co_changes DESC, other) AS position FROM directed)
        WHERE position <= 5""",
    "partners": "SELECT path, count(*) AS sum_coupling FROM directed GROUP BY path",
    "lists": """
        SELECT path, string_agg(other, ',' ORDER BY position) AS coupled,
               list(other ORDER BY other) AS coupled_list
        FROM top GROUP BY path""",
    "history": """
        SELECT c.*, coalesce(authors, 0) AS authors, coalesce(recent_authors, 0) AS recent_authors,
               coalesce(primary_author_share, 0.0) AS primary_author_share,
               coalesce(sum_coupling, 0) AS sum_coupling, coalesce(coupled, '') AS coupled,
               coalesce(coupled_list, []) AS coupled_list
        FROM churn c LEFT JOIN authorship USING (path) LEFT JOIN partners USING (path)
        LEFT JOIN lists USING (path)""",
    "edges": """
        SELECT DISTINCT s.path AS src, t.path AS dst FROM lineitem
        JOIN units s ON s.unit_id = l_partkey JOIN units t ON t.unit_id = l_suppkey
        WHERE s.path <> t.path""",
    "fans": """
        SELECT path, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM units
        LEFT JOIN (SELECT dst AS path, count(DISTINCT src) AS fan_in FROM edges GROUP BY 1)
          USING (path)
        LEFT JOIN (SELECT src AS path, count(DISTINCT dst) AS fan_out FROM edges GROUP BY 1)
          USING (path)""",
    "targets": "SELECT * FROM units WHERE kind = 'source'",
    "metrics": """
        SELECT path, max_cyclomatic, coalesce(recent_commits, 0) AS recent_commits,
               coalesce(bug_fix_commits, 0) AS bug_fix_commits
        FROM targets LEFT JOIN churn USING (path)""",
    "ranks": """
        SELECT path, recent_commits, bug_fix_commits, max_cyclomatic,
          CASE WHEN min(recent_commits) OVER () = max(recent_commits) OVER () THEN 0.0 ELSE
            ((rank() OVER (ORDER BY recent_commits) - 1) * 2
              + count(*) OVER (PARTITION BY recent_commits) - 1) / 2.0 / (count(*) OVER () - 1)
            END AS recent_commits_rank,
          CASE WHEN min(bug_fix_commits) OVER () = max(bug_fix_commits) OVER () THEN 0.0 ELSE
            ((rank() OVER (ORDER BY bug_fix_commits) - 1) * 2
              + count(*) OVER (PARTITION BY bug_fix_commits) - 1) / 2.0 / (count(*) OVER () - 1)
            END AS bug_fix_commits_rank,
          CASE WHEN min(max_cyclomatic) OVER () = max(max_cyclomatic) OVER () THEN 0.0 ELSE
            ((rank() OVER (ORDER BY max_cyclomatic) - 1) * 2
              + count(*) OVER (PARTITION BY max_cyclomatic) - 1) / 2.0 / (count(*) OVER () - 1)
            END AS max_cyclomatic_rank
        FROM metrics""",
    "signals": """
        SELECT path, recent_commits_rank * 3.0::DOUBLE AS churn,
               bug_fix_commits_rank * 3.0::DOUBLE AS defect,
               max_cyclomatic_rank * 3.0::DOUBLE AS complexity
        FROM ranks""",
    "evidence": """
        SELECT t.*, f.fan_in, f.fan_out, s.churn, s.defect, s.complexity, m.recent_commits,
               m.bug_fix_commits, coalesce(h.commits, 0) AS commits
        FROM targets t JOIN fans f USING (path) JOIN signals s USING (path)
        JOIN metrics m USING (path) LEFT JOIN history h USING (path)""",
    "answers": """
        SELECT *,
          fan_in::DOUBLE / (fan_in::DOUBLE + 5.0::DOUBLE) * 3.0::DOUBLE AS s_criticality,
          (fan_in::DOUBLE + 1.0::DOUBLE) / (fan_in::DOUBLE + 3.0::DOUBLE) AS c_criticality,
          (fan_in + fan_out)::DOUBLE / ((fan_in + fan_out)::DOUBLE + 10.0::DOUBLE) * 3.0::DOUBLE
            AS s_blast,
          ((fan_in + fan_out)::DOUBLE + 1.0::DOUBLE)
            / ((fan_in + fan_out)::DOUBLE + 4.0::DOUBLE) AS c_blast,
          15.0::DOUBLE / (max_cyclomatic::DOUBLE + 5.0::DOUBLE) AS s_cohesion,
          10.0::DOUBLE / (max_cyclomatic::DOUBLE + 10.0::DOUBLE) AS c_cohesion,
          (recent_commits + bug_fix_commits)::DOUBLE
            / ((recent_commits + bug_fix_commits)::DOUBLE + 4.0::DOUBLE) * 3.0::DOUBLE AS s_change,
          (commits::DOUBLE + 1.0::DOUBLE) / (commits::DOUBLE + 6.0::DOUBLE) AS c_change
        FROM evidence""",
    "factors": """
        SELECT *,
          1.2::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, s_criticality / 3.0::DOUBLE)) AS w1,
          1.2::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, s_blast / 3.0::DOUBLE)) AS w2,
          0.8::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, s_change / 3.0::DOUBLE)) AS w3,
          0.6::DOUBLE * greatest(0.0::DOUBLE,
            least(1.0::DOUBLE, (3.0::DOUBLE - s_cohesion) / 3.0::DOUBLE)) AS w4,
          1.0::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, churn / 3.0::DOUBLE)) AS w5,
          1.0::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, defect / 3.0::DOUBLE)) AS w6,
          1.0::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, complexity / 3.0::DOUBLE)) AS w7,
          (1.2::DOUBLE * c_criticality + 1.2::DOUBLE * c_blast + 0.6::DOUBLE * c_cohesion
            + 0.8::DOUBLE * c_change)
            / (1.2::DOUBLE + 1.2::DOUBLE + 0.6::DOUBLE + 0.8::DOUBLE) AS judged_confidence,
          concat_ws(', ', CASE WHEN c_criticality < 0.5 THEN 'criticality' END,
            CASE WHEN c_blast < 0.5 THEN 'blast_radius' END,
            CASE WHEN c_cohesion < 0.5 THEN 'cohesion' END,
            CASE WHEN c_change < 0.5 THEN 'change_risk' END) AS doubts
        FROM answers""",
    "scores": """
        SELECT *, w1 + w2 + w3 + w4 + w5 + w6 + w7 AS weighted,
          floor((w1 + w2 + w3 + w4 + w5 + w6 + w7)
            / (1.2::DOUBLE + 1.2::DOUBLE + 0.8::DOUBLE + 0.6::DOUBLE + 1.0::DOUBLE + 1.0::DOUBLE
               + 1.0::DOUBLE) * 1000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS raw_priority
        FROM factors""",
    "shares": """
        SELECT path, name, place, share, row_number() OVER (PARTITION BY path
                 ORDER BY share DESC, place) AS position
        FROM (SELECT path, unnest(['criticality', 'blast_radius', 'change_risk', 'low_cohesion',
                'churn', 'defect_history', 'complexity']) AS name,
                unnest([1, 2, 3, 4, 5, 6, 7]) AS place,
                unnest([w1 / weighted, w2 / weighted, w3 / weighted, w4 / weighted, w5 / weighted,
                        w6 / weighted, w7 / weighted]) AS share
              FROM scores WHERE weighted <> 0)
        WHERE share > 0""",
    "drivers": """
        SELECT path, string_agg(name, ', ' ORDER BY position) AS drivers
        FROM shares WHERE position <= 2 GROUP BY path""",
    "run": """
        SELECT s.path, s.kind, s.bytes, s.hash, s.export, s.max_cyclomatic, s.fan_in, s.fan_out,
          s.churn, s.defect, s.complexity, s.error,
          CASE WHEN s.error IS NULL THEN raw_priority ELSE 0.0 END AS priority,
          CASE WHEN s.error IS NULL THEN judged_confidence ELSE 0.0 END AS confidence,
          CASE WHEN s.error IS NULL THEN coalesce(d.drivers, '') ELSE '' END AS drivers,
          CASE WHEN s.error IS NULL THEN doubts ELSE '' END AS uncertain
        FROM scores s LEFT JOIN drivers d USING (path)""",
    "scored": "SELECT * FROM run WHERE error IS NULL",
    "member_areas": """
        SELECT '' AS area, r.* FROM run r
        UNION ALL SELECT split_part(path, '/', 1), r.* FROM run r
        UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), r.*
        FROM run r""",
    "best": """
        SELECT area, arg_min(struct_pack(path := path, priority := priority,
                 confidence := confidence, drivers := drivers),
                 row(-priority, string_split(path, '/'))) FILTER (error IS NULL) AS b,
               count(*) AS units
        FROM member_areas GROUP BY area""",
    "areas": """
        SELECT area AS path, units, coalesce(b.priority, 0.0) AS priority,
               coalesce(b.confidence, 0.0) AS confidence, coalesce(b.drivers, '') AS drivers,
               b.path AS hot, b IS NULL AS error
        FROM best""",
    "nodes": """
        SELECT path, CASE WHEN path = '' THEN '.' ELSE split_part(path, '/', -1) END AS name,
               'area' AS kind, CAST(units AS BIGINT) AS units, priority, confidence, drivers, hot,
               error,
               CASE WHEN hot IS NULL THEN 'no scored units' ELSE 'hottest '
                 || CASE WHEN path = '' THEN hot ELSE substr(hot, length(path) + 2) END
                 || ' (' || printf('%.1f', priority) || ') via '
                 || CASE WHEN drivers = '' THEN 'no dominant driver' ELSE drivers END END AS hint,
               CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth,
               CASE WHEN path = '' THEN NULL WHEN strpos(path, '/') = 0 THEN ''
                 ELSE split_part(path, '/', 1) END AS parent
        FROM areas
        UNION ALL
        SELECT path, split_part(path, '/', -1), 'unit', 1, priority, confidence, drivers, path,
               error IS NOT NULL,
               CASE WHEN error IS NOT NULL THEN 'unscored: ' || error ELSE
                 CASE WHEN drivers = '' THEN 'no dominant driver' ELSE drivers END
                 || CASE WHEN uncertain = '' THEN '' ELSE ' · uncertain: ' || uncertain END END,
               3, split_part(path, '/', 1) || '/' || split_part(path, '/', 2)
        FROM run""",
    "ranked_areas": """
        SELECT CASE WHEN area = '' THEN '.' ELSE area END AS area, path, priority, confidence,
               drivers, uncertain,
               row_number() OVER (PARTITION BY area ORDER BY priority DESC, path) AS position
        FROM member_areas WHERE error IS NULL""",
    "run_couplings": """
        SELECT t.path, t.position, t.other, t.co_changes, t.strength,
               CAST(floor(t.strength * 100.0 + 0.5) AS BIGINT) || '%' AS label
        FROM top t JOIN run USING (path)""",
    "impact": """
        SELECT i.path, i.affected, coalesce(r.priority, 0.0) AS priority, i.relation
        FROM (SELECT dst AS path, src AS affected, 'imports it' AS relation
              FROM edges WHERE dst IN (SELECT path FROM run)
              UNION ALL
              SELECT c.path, c.other, 'co-changes ' || c.label FROM run_couplings c
              WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = c.path AND e.src = c.other)) i
        LEFT JOIN run r ON r.path = i.affected""",
    "members": """
        SELECT a.area, a.position, a.path, a.priority, coalesce(l.coupled_list, []) AS coupled
        FROM ranked_areas a LEFT JOIN lists l USING (path) WHERE a.position <= 10""",
    "conflicts": """
        SELECT f.area, f.position AS first_at, s.position AS second_at, f.path AS first,
               s.path AS second
        FROM members f JOIN members s ON f.area = s.area AND f.position < s.position
        WHERE list_contains(f.coupled, s.path) OR list_contains(s.coupled, f.path)
           OR list_has_any(f.coupled, s.coupled)
           OR EXISTS (SELECT 1 FROM edges e WHERE (e.src = f.path AND e.dst = s.path)
                        OR (e.src = s.path AND e.dst = f.path))""",
    "masked": """
        SELECT m.area, m.position, m.path, m.priority,
               CAST(coalesce((SELECT sum(pow(2, c.first_at - 1)) FROM conflicts c
                 WHERE c.area = m.area AND c.second_at = m.position), 0) AS BIGINT) AS mask
        FROM members m""",
    "texts": """
        SELECT source || '/' || lang || '/doc_' || doc_id AS path, text AS content, lang
        FROM documents""",
    "source_paths": """
        SELECT CASE lang
            WHEN 'en' THEN source || '/en/doc_' || doc_id || CASE WHEN n_chars < 500 THEN '.test.ts'
              WHEN n_chars > 5000 THEN '.min.js' ELSE '.ts' END
            WHEN 'de' THEN source || '/de/' || CASE WHEN n_chars < 500 THEN 'test_' ELSE '' END
              || 'doc_' || doc_id || '.py'
            WHEN 'fr' THEN source || '/fr/doc_' || doc_id
              || CASE WHEN n_chars < 500 THEN '_test' ELSE '' END || '.go'
            ELSE source || CASE WHEN n_chars < 500 THEN '/tests/' ELSE '/es/' END || 'doc_'
              || doc_id || '.rs' END AS path
        FROM documents""",
    "left_out": """
        SELECT path FROM source_paths WHERE regexp_matches(path, '\\.min\\.js$')""",
    "entries": """
        SELECT path || ':' || sha256(coalesce(content, '')) AS entry FROM texts
        UNION ALL SELECT path || ':skipped' FROM left_out""",
    "lanes_in": """
        SELECT sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT) AS l0,
               sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)::HUGEINT) AS l1,
               sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)::HUGEINT) AS l2,
               sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)::HUGEINT) AS l3,
               count(*) AS entries
        FROM (SELECT sha256(entry) AS h FROM entries)""",
    "whole_in": """
        SELECT sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT) AS l0,
               sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)::HUGEINT) AS l1,
               sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)::HUGEINT) AS l2,
               sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)::HUGEINT) AS l3,
               count(*) AS entries
        FROM (SELECT sha256(path || ':' || sha256(coalesce(content, ''))) AS h FROM texts)""",
    "graph_prints": """
        SELECT f.path, substr(sha256(concat_ws('|', f.fan_out, f.fan_in, coalesce(l0, 0),
                 coalesce(l1, 0), coalesce(l2, 0), coalesce(l3, 0))), 1, 16) AS graph_fingerprint
        FROM fans f LEFT JOIN (
          SELECT dst AS path, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT) AS l0,
                 sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)::HUGEINT) AS l1,
                 sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)::HUGEINT) AS l2,
                 sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)::HUGEINT) AS l3
          FROM (SELECT dst, sha256(src) AS h FROM edges) GROUP BY dst) USING (path)""",
    "keys": """
        SELECT path, hash, max_cyclomatic, error, state,
               substr(sha256('3|' || hash || '|judge-1|' || state), 1, 32) AS key
        FROM (SELECT t.path, t.hash, t.max_cyclomatic, t.error, substr(sha256(array_to_string([
                graph_fingerprint, coalesce(commits::VARCHAR, chr(0)),
                coalesce(recent_commits::VARCHAR, chr(0)), coalesce(authors::VARCHAR, chr(0)),
                coalesce(CAST(floor(primary_author_share * 100 + 0.5) AS BIGINT)::VARCHAR, chr(0)),
                coalesce(bug_fix_commits::VARCHAR, chr(0)), coalesce(last_modified, chr(0)),
                coalesce(array_to_string(coupled_list, ','), chr(0)), '1',
                (max_cyclomatic + 1)::VARCHAR, max_cyclomatic::VARCHAR,
                CAST(floor(max_cyclomatic / 10) AS BIGINT)::VARCHAR,
                (max_cyclomatic * 2)::VARCHAR], '|')), 1, 16) AS state
              FROM targets t JOIN graph_prints USING (path) LEFT JOIN history USING (path))""",
    "cached": """
        SELECT DISTINCT substr(sha256('3|'
          || CASE WHEN max_cyclomatic % 5 = 0 THEN sha256(hash || '-old') ELSE hash END
          || CASE WHEN max_cyclomatic % 7 = 0 THEN '|judge-0|' ELSE '|judge-1|' END
          || state || CASE WHEN max_cyclomatic % 3 = 0 THEN '0' ELSE '' END), 1, 32) AS key
        FROM keys WHERE max_cyclomatic < 40""",
    "ledger": """
        SELECT 'run_' || user_id || '_' || strftime(CAST(ts AS DATE), '%Y%m%d') AS id,
               strftime(CAST(ts AS DATE), '%Y-%m-%dT00:00:00Z') AS started_at,
               'judge-1' AS model, count(*) AS calls,
               count_if(event_type = 'view') AS cached, count_if(event_type = 'error') AS failed,
               CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS input_tokens,
               CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS output_tokens
        FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "leaders": """
        SELECT area, path, priority FROM (SELECT area, path, priority,
                 row_number() OVER (PARTITION BY area ORDER BY priority DESC, path) AS position
               FROM member_areas) WHERE position = 1""",
    "offered": """
        SELECT path, kind, priority, 0 AS up, parent AS area FROM nodes WHERE path <> ''
        UNION ALL
        SELECT n.path, n.kind, n.priority, 1, p.parent FROM nodes n JOIN nodes p
          ON n.parent = p.path WHERE p.parent IS NOT NULL""",
    "page_paths": """
        SELECT regexp_replace(url, '^[a-z]+://', '') || '/page_' || page_id AS path,
               CAST(length(html) AS DOUBLE) AS priority
        FROM pages""",
}


def with_ctes(final: str) -> str:
    """Prefix a statement with the CTEs it uses, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(final)
    if not order:
        return final
    body = ",\n".join(f"{name} AS ({CTES[name]})" for name in order)
    text = final.strip()
    if text.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {body},\n{text.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {body}\n{text}"
