"""The registered queries as plain SQL over the same tables, for the correctness check."""

from __future__ import annotations

import re

from cartloom.functions.fixed_values import ORDER_ONLY_ITEMS
from cartloom.queries import FORMAT_EXAMPLES, LABEL_EXAMPLES


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _rows(rules: list[tuple], cast: str = "VARCHAR") -> str:
    rows = [
        "(" + ", ".join(f"CAST({_text(v)} AS {cast})" for v in rule) + f", {at})"
        for at, rule in enumerate(rules, 1)
    ]
    return ", ".join(rows)


ORDER_ONLY = ", ".join(_text(t) for t in ORDER_ONLY_ITEMS)
BLANKS = "chr(9) || chr(10) || chr(13) || ' '"

MATCHES = """CASE match_name
    WHEN 'equal' THEN item = text_name
    WHEN 'contains' THEN regexp_matches(item, text_name)
    WHEN 'starts with' THEN starts_with(item, text_name)
    WHEN 'ends with' THEN suffix(item, text_name) END"""


def _packing(max_rows: int) -> str:
    cap = max_rows - 1
    full1, full2 = f"m.n + w.r1 >= {cap}", f"m.n + w.r2 >= {cap}"
    # 0 opens a page, 1 and 2 are the columns of the open page
    where = f"""CASE WHEN {full1} AND {full2} THEN 0
        WHEN {full1} THEN 2 WHEN {full2} THEN 1 WHEN w.m1 > w.m2 THEN 2 ELSE 1 END"""
    return f"""
    SELECT group_name, id, i, n, page, col, ahead, r1, r2, m1, m2 FROM (
        SELECT m.group_name, m.id, m.i, m.n,
            CASE WHEN m.n >= {cap} AND m.group_name <> (SELECT min(group_name) FROM sizes) THEN 2 ELSE 1 END
                ::BIGINT AS page,
            1 AS col, 0::BIGINT AS ahead, m.n AS r1, 0::BIGINT AS r2, 1 AS m1, 0 AS m2
        FROM numbered m WHERE i = 1)
    UNION ALL
    SELECT group_name, id, i, n, page + (c = 0)::INT, greatest(c, 1),
        CASE c WHEN 0 THEN 0 WHEN 1 THEN r1 ELSE r2 END,
        CASE c WHEN 0 THEN n WHEN 1 THEN r1 + n ELSE r1 END,
        CASE c WHEN 0 THEN 0 WHEN 2 THEN r2 + n ELSE r2 END,
        CASE c WHEN 0 THEN 1 WHEN 1 THEN m1 + 1 ELSE m1 END,
        CASE c WHEN 0 THEN 0 WHEN 2 THEN m2 + 1 ELSE m2 END
    FROM (SELECT m.group_name, m.id, m.i, m.n, w.page, w.r1, w.r2, w.m1, w.m2, {where} AS c
          FROM walk w JOIN numbered m ON m.group_name = w.group_name AND m.i = w.i + 1)"""


CTES = {
    "packed_tokens": """
    SELECT l_orderkey, string_agg((1 + l_linenumber % 2) || 'x'
        || CASE WHEN suffix(p_name, ' plate') THEN '1 Pot Plant - ' ELSE '1 Each ' END || p_name,
        ', ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "raw_orders": f"""
    SELECT o_orderkey + 1 AS id,
        CASE WHEN n_nationkey % 7 = 0 THEN 'Home Delivery - Zone ' || n_name || ' ' ELSE n_name END AS group_name,
        CASE WHEN c_custkey % 501 <> 9 THEN split_part(c_name, '#', 1) END AS firstname,
        CASE WHEN o_orderkey % 20 = 3 THEN chr(9) ELSE '' END || split_part(c_name, '#', 2)
            || CASE WHEN n_nationkey % 7 <> 0 THEN ''
                WHEN o_orderkey % 50 = 7 THEN ' none' ELSE ' ' || right(n_name, 4) END AS lastname,
        CASE WHEN o_orderkey % 1009 <> 5 THEN concat_ws(', ',
            '1 ' || c_mktsegment,
            CASE WHEN o_orderkey % 10 <> 0 THEN '1x' || left(o_orderpriority, 1) || ' @' || (4 + o_orderkey % 3)
                || '-' || (4 + o_orderkey % 3) || ':30 ' || r_name || ' Pickup Time' END,
            CASE WHEN o_orderkey % 10 = 1 THEN '1x9 @3-3:30 ' || r_name || ' Pickup Time' END,
            CASE WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey % 2 = 0
                THEN {_text(ORDER_ONLY_ITEMS[0])} ELSE {_text(ORDER_ONLY_ITEMS[3])} END END,
            items) || CASE WHEN o_orderkey % 13 = 4 THEN ',' ELSE '' END END AS packed
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey LEFT JOIN packed_tokens ON o_orderkey = l_orderkey""",
    "trimmed": f"""
    SELECT id, trim(group_name, {BLANKS}) AS site, firstname, trim(lastname, {BLANKS}) AS surname, packed,
        contains(group_name, 'Home Delivery -') AS home, right(site, 4) AS v1, right(surname, 4) AS v2
    FROM raw_orders""",
    "normalised": f"""
    SELECT id, CASE WHEN home THEN 'Home Delivery - ' || v1 ELSE site END AS group_name, firstname,
        CASE WHEN home AND strpos(surname, v1) > 0
            THEN trim(left(surname, strpos(surname, v1) - 1) || substr(surname, strpos(surname, v1) + length(v1)),
                {BLANKS})
            ELSE surname END AS lastname,
        packed
    FROM trimmed""",
    "shares": """
    SELECT CASE WHEN n_nationkey % 7 = 0 THEN 'Home Delivery - ' || right(n_name, 4) ELSE n_name END AS long_name,
        CASE n_nationkey % 4 WHEN 1 THEN 'N' || n_nationkey WHEN 2 THEN '' END AS short_name,
        coalesce(nullif(short_name, ''), long_name) AS group_name,
        r_name AS food,
        CASE WHEN n_nationkey % 6 <> 5 THEN '#' || right('000000' || (n_nationkey * 12345), 6) END AS hex,
        'rgb(' || (n_nationkey * 10) || ', ' || n_nationkey || ', ' || (255 - n_nationkey) || ')' AS rgb
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "members": """
    SELECT n.id, coalesce(s.group_name, n.group_name) AS group_name, firstname, lastname, packed,
        coalesce(lastname, 'NA') || ', ' || coalesce(firstname, 'NA') AS name_text,
        name_text || ' [' || n.id || ']' AS name_long
    FROM normalised n LEFT JOIN shares s ON n.group_name = s.long_name""",
    "pieces": """
    SELECT *, unnest(parts) AS piece, generate_subscripts(parts, 1)::INT - 1 AS seq
    FROM (SELECT id, CASE WHEN packed IS NULL THEN [NULL::VARCHAR]
            WHEN string_split(packed, ',')[-1] = '' THEN string_split(packed, ',')[:-2]
            ELSE string_split(packed, ',') END AS parts FROM raw_orders)""",
    "tokens": f"""
    SELECT id, seq, trim(piece, {BLANKS}) AS token,
        CASE WHEN strpos(token, 'x') > 0 THEN left(token, strpos(token, 'x') - 1) END AS head,
        CASE WHEN strpos(token, 'x') > 0 THEN substr(token, strpos(token, 'x') + 1) ELSE token END AS item,
        nullif(head, item) AS quantity
    FROM pieces""",
    "lines": f"""
    SELECT m.group_name, m.firstname, m.lastname, m.id, m.name_long, t.seq, t.quantity, t.item,
        t.token AS item_original,
        CASE WHEN t.quantity IS NULL AND t.item IS NOT NULL AND t.item NOT IN ({ORDER_ONLY}) THEN 1
            WHEN contains(t.token, 'Pickup Time') THEN 2 ELSE 3 END AS rank
    FROM members m JOIN tokens t USING (id)""",
    "slots": """
    SELECT id, item AS time_descr, description, time FROM (
        SELECT id, item, string_split(item, ' ') AS p,
            CASE WHEN len(p) > 2 THEN array_to_string(p[3:], ' ') END AS description,
            CASE WHEN len(p) > 1 THEN p[2] END AS time,
            row_number() OVER (PARTITION BY id ORDER BY description NULLS LAST, time NULLS LAST, seq) AS rn
        FROM lines WHERE rank = 2) WHERE rn = 1""",
    "headers": """
    SELECT DISTINCT group_name, '0' AS firstname, '0' AS lastname, 0::BIGINT AS id, '0, 0 [0]' AS name_long,
        -1 AS seq, NULL::VARCHAR AS quantity, group_name AS item, group_name AS item_original, -1 AS rank
    FROM members""",
    "name_rows": """
    SELECT group_name, firstname, lastname, id, name_long, -1 AS seq, NULL::VARCHAR AS quantity,
        name_text AS item, name_text AS item_original, 0 AS rank FROM members""",
    "spacers": """
    SELECT group_name, firstname, lastname, id, name_long, 2147483647 AS seq, NULL::VARCHAR AS quantity,
        NULL::VARCHAR AS item, NULL::VARCHAR AS item_original, 4 AS rank FROM members""",
    "long_lines": """
    SELECT l.*, time_descr, CASE WHEN rank = -1 THEN '.....' ELSE description END AS description, time FROM (
        SELECT group_name, firstname, lastname, id, name_long, seq, quantity, item, item_original, rank FROM lines
        UNION ALL SELECT * FROM headers UNION ALL SELECT * FROM name_rows UNION ALL SELECT * FROM spacers) l
    LEFT JOIN slots USING (id)""",
    "rotation": """
    SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) + 2 AS date,
        weekofyear(date)::INT AS week,
        CASE WHEN month(date) <= 6 THEN 'A' ELSE 'B' END || year(date) AS season FROM orders""",
    "pickup_days": """
    SELECT date, date + d::INT AS date_all,
        CASE WHEN length(week::VARCHAR) = 1 THEN '0' || week ELSE week::VARCHAR END AS week, season
    FROM rotation, (VALUES (0), (1), (2)) v(d)""",
    "run": """
    SELECT DISTINCT ' (' || season || 'w' || week || ' - ' || date_all || ')' AS suffix FROM pickup_days
    WHERE date_all = (SELECT max(date_all) FROM pickup_days)""",
    "permanent": """
    SELECT DISTINCT CASE WHEN p_name LIKE 'red %' AND p_name NOT LIKE '% plate' THEN '1 Each ' || p_name END AS item
    FROM part""",
    "temporary": "SELECT DISTINCT '1 Each ' || p_name AS item FROM part WHERE p_name LIKE '% gizmo'",
    "top_tokens": """
    SELECT food, item_original FROM (
        SELECT food, item_original,
            row_number() OVER (PARTITION BY food ORDER BY count(*) DESC, item_original) AS place
        FROM lines JOIN shares USING (group_name)
        WHERE rank = 3 AND quantity IS NOT NULL AND food <> 'AFRICA' GROUP BY food, item_original)
    JOIN region ON food = r_name WHERE place <= 1 + r_regionkey % 2""",
    "one_liners": """
    SELECT food, arg_min(name_long, id) AS name_long FROM (
        SELECT food, id, name_long FROM lines JOIN shares USING (group_name) WHERE rank = 3
        GROUP BY food, id, name_long HAVING count(*) = 1 AND count(quantity) = 1)
    GROUP BY food""",
    "std_members": """
    SELECT food, CASE WHEN food = 'AFRICA' THEN name_long END AS name_long,
        CASE WHEN food = 'AFRICA' THEN false END AS keep_remove FROM one_liners""",
    "std_lines": """
    SELECT DISTINCT food, item_original, item FROM (
        SELECT s.food, item_original, item FROM lines JOIN std_members s USING (name_long) WHERE rank = 3
        UNION ALL
        SELECT food, item_original, CASE WHEN strpos(item_original, 'x') > 0
            THEN substr(item_original, strpos(item_original, 'x') + 1) END FROM top_tokens)""",
    "std_flags": """
    SELECT DISTINCT s.group_name, item FROM std_lines LEFT JOIN shares s USING (food)""",
    "std_sets": """
    SELECT group_name, item_original, count(*) OVER (PARTITION BY group_name) AS size FROM (
        SELECT DISTINCT s.group_name, item_original FROM std_lines JOIN shares s USING (food))""",
    "cart_items": """
    SELECT c.*, s.size FROM (
        SELECT id, name_long, group_name, item_original, min(seq) AS seq FROM lines WHERE rank = 3
        GROUP BY id, name_long, group_name, item_original) c
    LEFT JOIN std_sets s ON s.group_name = c.group_name AND s.item_original IS NOT DISTINCT FROM c.item_original""",
    "matches": """
    SELECT id, name_long, group_name, max(size) AS s, count(size) AS m, count(*) - count(size) AS u,
        max(seq) AS last_line, max(seq) FILTER (size IS NOT NULL) AS last_std,
        coalesce(s = m AND u = 0, false) AS is_full,
        coalesce(s = m AND u > 0, false) AS holds,
        holds AND last_line = last_std AS is_extra
    FROM cart_items GROUP BY id, name_long, group_name""",
    "flagged": """
    SELECT m.*, CASE WHEN is_full THEN coalesce(keep_remove, true) ELSE true END AS keep
    FROM matches m LEFT JOIN std_members s USING (name_long)""",
    "collapsed": f"""
    WITH hit AS (SELECT id, is_extra FROM flagged WHERE keep AND (is_full OR is_extra))
    SELECT group_name, firstname, lastname, id, name_long, seq, quantity, item, rank, description, time
        FROM long_lines WHERE id NOT IN (SELECT id FROM hit) OR rank <= 2 OR rank = 4
    UNION ALL
    SELECT group_name, firstname, lastname, m.id, name_long, -1, NULL, 'STANDARD SHARE ITEMS', 3, description, time
        FROM members m JOIN hit USING (id) LEFT JOIN slots USING (id)
    UNION ALL
    SELECT l.group_name, firstname, lastname, l.id, l.name_long, l.seq, l.quantity, l.item, l.rank,
            l.description, l.time
        FROM long_lines l JOIN hit h ON h.id = l.id AND h.is_extra
        WHERE l.rank = 3 AND NOT EXISTS (SELECT 1 FROM std_sets s WHERE s.group_name = l.group_name
            AND s.item_original IS NOT DISTINCT FROM l.item_original)""",
    "only_extra": f"""
    SELECT id FROM collapsed WHERE rank >= 0 GROUP BY id
    HAVING count(*) FILTER (rank = 3) = 1 AND bool_or(coalesce(item IN ({ORDER_ONLY}), false))""",
    "kept": """
    SELECT * FROM collapsed c WHERE id NOT IN (SELECT id FROM only_extra)
        AND NOT EXISTS (SELECT 1 FROM permanent d WHERE d.item = c.item)
        AND NOT EXISTS (SELECT 1 FROM temporary d WHERE d.item = c.item)
        AND NOT coalesce(contains(item, 'Pot Plant'), false)""",
    "sizes": """
    SELECT group_name, description, time, lastname, firstname, id, count(*) AS n FROM kept WHERE rank >= 0
    GROUP BY ALL""",
    "numbered": """
    SELECT group_name, id, n, row_number() OVER (PARTITION BY group_name ORDER BY description NULLS LAST,
        time NULLS LAST, lastname NULLS LAST, firstname NULLS LAST, n DESC, id) AS i FROM sizes""",
    "walk": _packing(46),
    "short_walk": _packing(12).replace("walk w", "short_walk w"),
}

CELLS = """
    SELECT group_name, page AS page_n, col AS column_n, ahead + 1 + row_number() OVER (PARTITION BY k.id
        ORDER BY k.rank, k.seq) AS row_n, k.id, n, rank, quantity, item, std.item IS NOT NULL AS bold_item
    FROM {walk} w JOIN kept k USING (group_name, id)
        LEFT JOIN std_flags std USING (group_name, item) WHERE rank >= 0
    UNION ALL
    SELECT group_name, page, col, 1, 0, 1, -1, NULL, group_name, false FROM {walk} WHERE ahead = 0"""
CTES["cells"] = CELLS.format(walk="walk")
CTES["short_cells"] = CELLS.format(walk="short_walk")
CTES["grid"] = """
    SELECT s.group_name, s.page_n, s.r::INT AS row_n, s.c::INT AS column_n, x.id, x.n::INT AS n, x.rank,
        x.quantity, x.item, CASE WHEN bold_item THEN 1 END AS standard_item
    FROM (SELECT DISTINCT group_name, page AS page_n, r, c FROM walk, range(1, 47) r(r), (VALUES (1), (2)) v(c)) s
        LEFT JOIN cells x ON x.group_name = s.group_name AND x.page_n = s.page_n AND x.row_n = s.r
            AND x.column_n = s.c"""
CTES["sheet"] = """
    SELECT group_name, page_n, row_n, max(item) FILTER (column_n = 1) AS item_1,
        max(item) FILTER (column_n = 2) AS item_2 FROM grid GROUP BY group_name, page_n, row_n"""
CTES["label_rules"] = (
    f"SELECT * FROM (VALUES {_rows(LABEL_EXAMPLES)}) v(match_name, text_name, freeform_text, emoji_name, row_num)"
)
CTES["format_rules"] = (
    f"SELECT * FROM (VALUES {_rows(FORMAT_EXAMPLES)}) v(match_name, text_name, format_name, color_name, row_num)"
)
CTES["symbols"] = f"""
    SELECT item, string_agg(symbol, '' ORDER BY symbol) AS symbol_text FROM (
        SELECT item, coalesce(emoji_name, '') || coalesce(freeform_text, '') AS symbol
        FROM (SELECT DISTINCT item FROM long_lines WHERE item IS NOT NULL), label_rules
        WHERE {MATCHES} AND (emoji_name IS NOT NULL OR freeform_text IS NOT NULL)) GROUP BY item"""
LABEL = """CASE WHEN coalesce(quantity, '') > '1' THEN '+' ELSE '' END || coalesce(symbol_text, '')
        || CASE WHEN coalesce(quantity, '') = '' THEN coalesce(item, '') ELSE quantity || 'x' || coalesce(item, '') END"""
CTES["formats"] = f"""
    SELECT item, max(row_num) AS row_num FROM (SELECT DISTINCT item FROM cells WHERE item IS NOT NULL), format_rules
    WHERE {MATCHES} AND (format_name IS NOT NULL OR color_name IS NOT NULL) GROUP BY item"""
CTES["winning"] = """
    SELECT f.item, r.format_name, r.color_name FROM formats f JOIN format_rules r USING (row_num)"""
CTES["styled"] = """
    SELECT c.group_name, c.page_n, c.row_n::INT AS row_n, c.column_n::INT AS column_n,
        CASE WHEN c.rank <= 0 THEN s.hex END AS fill_if_text,
        fill_if_text IS NOT NULL OR c.bold_item AS bold_if_text,
        CASE WHEN f.item IS NULL AND fill_if_text IS NOT NULL THEN 'center' END AS halign,
        f.format_name AS text_decoration, f.color_name AS fill
    FROM cells c LEFT JOIN shares s ON s.group_name = c.group_name LEFT JOIN winning f ON f.item = c.item"""
CTES["part_rules"] = """
    SELECT 'ends with' AS match_name, p_name AS text_name, '*' AS freeform_text,
        row_number() OVER (ORDER BY p_name) AS row_num FROM (SELECT DISTINCT p_name FROM part)"""
CTES["search_rows"] = """
    SELECT l.group_name, l.name_long, l.item_original FROM long_lines l JOIN shares s USING (group_name)
    WHERE id > 0 AND food IN ('ASIA', 'EUROPE')"""

RECURSIVE = {"walk", "short_walk"}

FINAL = {
    "picks_per_slot": """
    SELECT group_name, description, time, lines.item, count(*) AS n_lines,
        sum(TRY_CAST(quantity AS DECIMAL(10,2)))::DOUBLE AS total_qty
    FROM lines LEFT JOIN slots USING (id) WHERE rank = 3 GROUP BY ALL""",
    "order_lines": "SELECT id, group_name, name_long, seq, quantity, item, item_original, rank FROM lines",
    "legacy_line_numbers": """
    SELECT group_name AS pickup_site, firstname AS first_name, lastname AS last_name, id, piece AS order_token,
        contains(piece, 'Pickup Time') AS pickuptime,
        row_number() OVER (PARTITION BY group_name, firstname, lastname ORDER BY id, seq) AS rank_v,
        row_number() OVER (PARTITION BY group_name, firstname, lastname ORDER BY id, seq) = 1 AS group_start,
        count(*) OVER (PARTITION BY group_name, firstname, lastname) AS rows_in_group
    FROM raw_orders JOIN pieces USING (id)""",
    "line_class_counts": "SELECT group_name, rank, count(*) AS n_lines FROM lines GROUP BY ALL",
    "short_group_names": "SELECT id, group_name FROM members",
    "home_delivery_normalised": "SELECT id, group_name, firstname, lastname FROM normalised",
    "home_delivery_check": """
    SELECT site AS group_name, firstname, surname AS lastname, v1 AS pickup_detail_v1, v2 AS pickup_detail_v2
    FROM trimmed WHERE home AND v1 <> v2""",
    "group_check": """
    SELECT group_name, firstname, lastname FROM normalised m
    WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = m.group_name)""",
    "members_start": """
    SELECT group_name, count(*) AS n_start FROM (SELECT DISTINCT group_name, firstname, lastname FROM members)
    GROUP BY group_name""",
    "members_end": """
    SELECT group_name, count(*) AS n_end FROM (
        SELECT DISTINCT group_name, firstname, lastname FROM kept WHERE rank >= 0) GROUP BY group_name""",
    "reconciliation": """
    SELECT coalesce(s.group_name, e.group_name) AS group_name, n_start, n_end, n_end - n_start AS difference
    FROM (SELECT group_name, count(*) AS n_start FROM (SELECT DISTINCT group_name, firstname, lastname FROM members)
          GROUP BY group_name) s
    FULL JOIN (SELECT group_name, count(*) AS n_end FROM (
          SELECT DISTINCT group_name, firstname, lastname FROM kept WHERE rank >= 0) GROUP BY group_name) e
        ON s.group_name = e.group_name""",
    "pickup_calendar": "SELECT date::VARCHAR AS date, date_all::VARCHAR AS date_all, week, season FROM pickup_days",
    "calendar_gaps": """
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS all_dates FROM (
        SELECT unnest(generate_series(min(date_all), max(date_all), INTERVAL 1 DAY)) AS d FROM pickup_days)
    WHERE CAST(d AS DATE) NOT IN (SELECT date_all FROM pickup_days)""",
    "pickup_histogram": """
    SELECT item, count(*) AS n_lines, string_split(item, ' ')[1] AS q, string_split(item, ' ')[2] AS time,
        array_to_string(string_split(item, ' ')[3:], ' ') AS description
    FROM lines WHERE rank = 2 GROUP BY item""",
    "first_pickup_slot": "SELECT id, time_descr, description, time FROM slots",
    "multi_pickup_members": """
    SELECT DISTINCT name_long, item, n_pickups FROM (
        SELECT name_long, item, count(*) OVER (PARTITION BY name_long) AS n_pickups FROM lines WHERE rank = 2)
    WHERE n_pickups > 1""",
    "synthetic_rows": """
    SELECT group_name, firstname, lastname, id, name_long, description, rank, item FROM long_lines
    WHERE rank IN (-1, 0, 4)""",
    "standard_items": "SELECT group_name, item, 1 AS standard_item FROM std_flags",
    "standard_full_match": "SELECT id, keep AS keep_remove FROM flagged WHERE is_full",
    "standard_with_extras": """
    SELECT c.id, c.item_original FROM cart_items c JOIN matches m USING (id) WHERE m.is_extra AND c.size IS NULL""",
    "standard_containment": """
    SELECT c.id, c.item_original FROM cart_items c JOIN matches m USING (id) WHERE m.holds AND c.size IS NULL""",
    "standard_collapsed": """
    SELECT c.group_name, c.id, c.name_long, c.rank, c.quantity, c.item,
        CASE WHEN f.group_name IS NOT NULL THEN 1 END AS standard_item
    FROM collapsed c LEFT JOIN std_flags f ON f.group_name = c.group_name AND f.item IS NOT DISTINCT FROM c.item""",
    "standard_summary": """
    SELECT group_name, name_long, keep AS in_printout, is_extra AS extra_items FROM flagged
    WHERE is_full OR is_extra""",
    "standards_conflict": """
    SELECT food AS food_list_group_name, count(name_long) AS name_cnt, count(item_original) AS item_cnt FROM (
        SELECT food, coalesce(name_long, '0, 0 [0]') AS name_long, NULL AS item_original FROM std_members
        UNION ALL SELECT food, NULL, item_original FROM top_tokens)
    GROUP BY food HAVING name_cnt > 0 AND item_cnt > 0""",
    "standards_coverage": """
    SELECT count(DISTINCT food) AS n_groups, count(DISTINCT food) < 5 AS incomplete FROM (
        SELECT food FROM std_members WHERE name_long IS NOT NULL UNION ALL SELECT food FROM top_tokens)""",
    "cart_search": """
    SELECT group_name, name_long, item_original FROM search_rows WHERE name_long IN (
        SELECT name_long FROM search_rows GROUP BY name_long
        HAVING bool_or(regexp_matches(lower(item_original), 'red'))
            AND bool_or(regexp_matches(lower(item_original), 'each .*ring$')))""",
    "cart_search_indexed": """
    SELECT group_name, name_long, item_original FROM search_rows WHERE name_long IN (
        SELECT name_long FROM search_rows GROUP BY name_long
        HAVING bool_or(regexp_matches(lower(item_original), 'red'))
            AND bool_or(regexp_matches(lower(item_original), 'each .*ring$')))""",
    "member_picklist": "SELECT DISTINCT name_long FROM search_rows",
    "item_picklist": """
    SELECT DISTINCT item_original, item FROM lines JOIN shares USING (group_name)
    WHERE rank = 3 AND food IN ('ASIA', 'EUROPE')""",
    "deletable_items": """
    SELECT DISTINCT item FROM collapsed WHERE rank = 3 AND item IS NOT NULL AND NOT contains(item, 'Pot Plant')""",
    "delete_report": """
    SELECT item, count(*) AS n_lines, 'permanent' AS list_name FROM collapsed
        WHERE item IN (SELECT item FROM permanent WHERE item IS NOT NULL) GROUP BY item
    UNION ALL SELECT item, count(*), 'temporary' FROM collapsed WHERE item IN (SELECT item FROM temporary) GROUP BY item
    UNION ALL SELECT item, count(*), 'plants' FROM collapsed WHERE contains(item, 'Pot Plant') GROUP BY item""",
    "order_only_members": "SELECT id FROM only_extra",
    "lines_after_delete": "SELECT group_name, id, name_long, rank, quantity, item FROM kept",
    "plant_extract": """
    SELECT group_name, lastname, firstname, item, quantity FROM collapsed WHERE contains(item, 'Pot Plant')""",
    "rows_per_member": "SELECT group_name, description, time, lastname, firstname, id, n::INT AS n FROM sizes",
    "page_packing": """
    SELECT group_name, id, n::INT AS n, page AS page_n, col::INT AS column_n, ahead::INT AS rows_ahead FROM walk""",
    "page_grid": """
    SELECT group_name, page_n, row_n, column_n, id, n, rank, quantity, item, standard_item FROM grid""",
    "two_column_sheet": "SELECT group_name, page_n, row_n, item_1, item_2 FROM sheet",
    "sheet_rows": """
    SELECT *, 46 * (dense_rank() OVER (ORDER BY group_name, page_n) - 1) + row_n AS sheet_row FROM sheet""",
    "sheet_files": """
    SELECT group_name, page_n, item_1, item_2, true AS in_place,
        46 * (dense_rank() OVER (ORDER BY group_name, page_n) - 1) + row_n AS sheet_row FROM sheet""",
    "page_subset": "SELECT group_name, page_n, row_n, item_1, item_2 FROM sheet WHERE group_name = 'N1' AND page_n = 1",
    "page_overflow": """
    SELECT group_name, page_n, row_n::INT AS row_n, column_n::INT AS column_n, id, n::INT AS n, rank, item
    FROM short_cells WHERE row_n > 12""",
    "item_symbols": """
    SELECT item, symbol_text FROM symbols WHERE item IN (SELECT item FROM long_lines WHERE rank >= 0)""",
    "item_labels": f"""
    SELECT id, group_name, rank, seq, {LABEL} AS item_symbol FROM long_lines LEFT JOIN symbols USING (item)""",
    "header_labels": f"""
    SELECT group_name, page_n, row_n::INT AS row_n, column_n::INT AS column_n,
        {LABEL} || CASE WHEN rank = -1 THEN (SELECT suffix FROM run) ELSE '' END AS label
    FROM cells LEFT JOIN symbols USING (item)""",
    "weekly_job": f"""
    SELECT s.group_name, s.page_n, s.row_n,
        max(CASE WHEN column_n = 1 THEN label END) AS item_1, max(CASE WHEN column_n = 2 THEN label END) AS item_2,
        46 * (dense_rank() OVER (ORDER BY s.group_name, s.page_n) - 1) + s.row_n AS sheet_row
    FROM sheet s LEFT JOIN (
        SELECT group_name, page_n, row_n, column_n,
            {LABEL} || CASE WHEN rank = -1 THEN (SELECT suffix FROM run) ELSE '' END AS label
        FROM cells LEFT JOIN symbols USING (item)) c
        ON c.group_name = s.group_name AND c.page_n = s.page_n AND c.row_n = s.row_n
    GROUP BY s.group_name, s.page_n, s.row_n""",
    "cell_group_colour": """
    SELECT c.group_name, page_n, row_n::INT AS row_n, column_n::INT AS column_n, hex AS highlight_color_hex,
        'bold' AS text_decoration, 'center' AS halign
    FROM cells c JOIN shares s ON s.group_name = c.group_name WHERE rank <= 0 AND hex IS NOT NULL""",
    "cell_standard_bold": """
    SELECT group_name, page_n, row_n::INT AS row_n, column_n::INT AS column_n, item, 'bold' AS text_decoration
    FROM cells WHERE bold_item""",
    "cell_format_rules": """
    SELECT group_name, page_n, row_n::INT AS row_n, column_n::INT AS column_n, item, format_name, color_name
    FROM cells JOIN winning USING (item)""",
    "cell_styles": """
    SELECT * FROM styled WHERE fill_if_text IS NOT NULL OR bold_if_text OR text_decoration IS NOT NULL
        OR fill IS NOT NULL""",
    "settings_append": "SELECT item FROM permanent UNION SELECT item FROM temporary",
    "settings_remove": "SELECT item FROM permanent WHERE item IS NOT NULL AND item <> '1 Each red bolt'",
    "settings_replaced": "SELECT item FROM permanent UNION SELECT item FROM temporary",
    "orders_file_rows": "SELECT " + ", ".join(
        f"nullif(nullif(trim({c}, {BLANKS}), ''), 'NA') AS {name}"
        for c, name in (("group_name", "group_name"), ("firstname", "firstname"), ("lastname", "lastname"), ("packed", "order_text"))
    ) + " FROM raw_orders",
    "orders_file_quarantine": f"""
    SELECT NOT (split OR short) AS kept,
        CASE WHEN NOT (split OR short) THEN nullif(nullif(trim(group_name, {BLANKS}), ''), 'NA') END AS group_name,
        CASE WHEN NOT (split OR short) THEN nullif(nullif(trim(firstname, {BLANKS}), ''), 'NA') END AS firstname,
        CASE WHEN NOT (split OR short) THEN nullif(nullif(last_name, ''), 'NA') END AS lastname,
        CASE WHEN split THEN start || ',' || lastname || ',' || tokens WHEN short THEN start
            ELSE nullif(nullif(trim(tokens, {BLANKS}), ''), 'NA') END AS order_text
    FROM (SELECT *, id % 41 = 3 AND contains(tokens, ',') AS split, id % 41 <> 3 AND id % 43 = 5 AS short
        FROM (SELECT *, group_name || ',' || coalesce(firstname, '') AS start,
            trim(lastname, {BLANKS}) AS last_name, coalesce(packed, '') AS tokens FROM raw_orders))""",
    "orders_file_ids": "SELECT row_number() OVER () AS id FROM raw_orders",
    "standards_upsert": """
    SELECT food AS food_list_group_name,
        CASE food WHEN 'ASIA' THEN 'Someone, New [1]' WHEN 'AFRICA' THEN NULL ELSE name_long END AS name_long,
        CASE food WHEN 'ASIA' THEN true WHEN 'AFRICA' THEN NULL ELSE keep_remove END AS keep_remove
    FROM std_members""",
    "rules_edit": """
    SELECT match_name, text_name, freeform_text, NULL::VARCHAR AS emoji_name,
        row_number() OVER (ORDER BY row_num)::INT AS row_num FROM (
        SELECT * FROM part_rules WHERE row_num <> 3
        UNION ALL SELECT 'equal', '1 Each red bolt', '!', 1 + (SELECT max(row_num) FROM part_rules))""",
    "keyword_lookup": """
    SELECT p_name AS name, upper(p_name) AS emoji, string_agg(p_brand, ',' ORDER BY p_brand) AS keyword_list
    FROM (SELECT DISTINCT p_name, p_brand FROM part) GROUP BY p_name
    HAVING regexp_matches(keyword_list, 'Brand#7|Brand#11')""",
    "rgb_parse": """
    SELECT long_name AS group_name, regexp_extract(rgb, '(\\d+)', 1)::INT / 255.0::DOUBLE AS red,
        regexp_extract(rgb, ', (\\d+),', 1)::INT / 255.0::DOUBLE AS green,
        regexp_extract(rgb, '(\\d+)\\)', 1)::INT / 255.0::DOUBLE AS blue FROM shares""",
    "preview_top": """
    SELECT group_name, description, time, lastname, firstname, id, rank, seq, item FROM long_lines
    ORDER BY group_name NULLS LAST, description NULLS LAST, time NULLS LAST, lastname NULLS LAST,
        firstname NULLS LAST, id, rank, seq LIMIT 20""",
}


def _needed(sql: str, found: list[str]) -> None:
    words = set(re.findall(r"\w+", sql))
    for name, body in CTES.items():
        if name in words and name not in found:
            if name in RECURSIVE:
                _needed(body.replace(name, ""), found)
            else:
                _needed(re.sub(rf"\b{name}\b", "", body), found)
            if name not in found:
                found.append(name)


def assemble(name: str) -> str:
    """The query with the common table expressions it needs."""
    needed: list[str] = []
    _needed(FINAL[name], needed)
    if not needed:
        return FINAL[name].strip()
    # shared steps are materialised, or the planner would evaluate them once per use
    blocks = [f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({CTES[n].strip()})" for n in needed]
    return "WITH RECURSIVE " + ",\n".join(blocks) + "\n" + FINAL[name].strip()


def oracle_sql() -> dict[str, str]:
    return {name: assemble(name) for name in FINAL}
