"""What the registered queries must return, as DuckDB SQL over the driver's tables."""

from __future__ import annotations

# The driver's tables read as league tables.
LEAGUE = """
course AS (
  SELECT s_suppkey + 1 AS id, s_name AS name, n_name AS city,
         CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE 'MN' END AS state,
         CAST(70 + s_suppkey % 3 AS INT) AS par
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
player AS (
  SELECT c_custkey + 1 AS id, substr(c_name, 1, 8) AS first_name, substr(c_name, 10) AS last_name,
         CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS nickname, n_name AS hometown,
         CASE WHEN c_custkey % 4 <> 0 THEN CAST(1990 + c_custkey % 30 AS INT) END AS debut_year,
         CAST(NULL AS VARCHAR) AS image_url, c_acctbal > 9000 AS hof_inducted,
         CAST(NULL AS INT) AS hof_year, CAST(NULL AS VARCHAR) AS accolades
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
event AS (
  SELECT o_orderkey + 1 AS id, 'Open ' || o_orderpriority AS name,
         CAST(o_orderdate AS DATE) AS date, o_custkey % 10 + 1 AS course_id,
         o_orderpriority <> '5-LOW' AS is_team_event,
         CASE WHEN o_orderstatus = 'P' THEN 'weather' END AS notes,
         CAST(year(o_orderdate) AS INT) AS season, o_orderpriority = '1-URGENT' AS is_major,
         CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN 'Masters' END
           AS major_label,
         o_orderstatus <> 'O' AS finalized
  FROM orders),
score AS (
  SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id,
         l_orderkey + 1 AS event_id,
         CAST(floor(l_partkey * 3 / 4) AS BIGINT) + 1 AS p1,
         CASE WHEN l_linenumber >= 2 THEN l_suppkey * 15 + l_linenumber + 1 END AS p2,
         CASE WHEN l_linenumber >= 5 THEN l_suppkey * 15 + 10 END AS p3,
         CASE WHEN l_linenumber = 7 THEN l_suppkey * 15 + 13 END AS p4,
         CASE WHEN l_quantity <> 50 THEN CAST(60 + CAST(l_quantity AS INT) % 30 AS INT) END
           AS strokes,
         CASE WHEN l_quantity < 50 AND l_linenumber % 2 = 0
              THEN CAST(CAST(l_quantity AS INT) % 30 - 12 AS INT) END AS to_par,
         CASE WHEN l_quantity <> 50 THEN CAST(CAST(l_quantity AS INT) % 5 + 1 AS INT) END
           AS placement,
         CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 'late card, Dq by rule'
              WHEN l_returnflag = 'A' THEN 'wind ' || l_linestatus END AS notes,
         (l_quantity = 50 OR (l_quantity = 46 AND l_returnflag = 'R')) AS disqualified
  FROM lineitem)"""

AS_OF = "DATE '1999-06-30'"

# Scores with everything known about their event, and the four members' names.
FULL = (
    LEAGUE
    + """,
named AS (SELECT id, first_name || ' ' || last_name AS n,
                 left(first_name, 1) || '. ' || last_name AS c FROM player),
wide AS (
  SELECT s.*, coalesce(s.to_par, s.strokes - k.par) AS relative,
         e.name AS event_name, e.date, e.season, e.is_major, e.finalized,
         k.name AS course_name, k.par AS course_par,
         a.n AS n1, b.n AS n2, c.n AS n3, d.n AS n4,
         array_to_string(list_filter([s.p1, s.p2, s.p3, s.p4], lambda x: x IS NOT NULL), ',')
           AS player_ids,
         concat_ws(' / ', a.c, b.c, c.c, d.c) AS team_name
  FROM score s JOIN event e ON e.id = s.event_id
  LEFT JOIN course k ON k.id = e.course_id
  LEFT JOIN named a ON a.id = s.p1 LEFT JOIN named b ON b.id = s.p2
  LEFT JOIN named c ON c.id = s.p3 LEFT JOIN named d ON d.id = s.p4)"""
)

NAMES = """coalesce(n1, '') AS player1_name, coalesce(n2, '') AS player2_name,
  coalesce(n3, '') AS player3_name, coalesce(n4, '') AS player4_name"""
STRICT_NAMES = "n1 AS player1_name, n2 AS player2_name, n3 AS player3_name, n4 AS player4_name"

# Shares are counted in 2520ths, which holds 1/1 to 1/10 exactly.
WINS = (
    LEAGUE
    + """,
place AS (
  SELECT unnest([p1, p2, p3, p4]) AS player_id, event_id,
         placement = 1 AND NOT disqualified AS won FROM score),
tied AS (SELECT event_id, count(*) AS teams FROM score
         WHERE placement = 1 AND NOT disqualified GROUP BY event_id),
entry AS (
  SELECT p.player_id, e.name AS event_name, e.is_major,
         CASE WHEN e.finalized THEN e.id END AS counted,
         CASE WHEN e.finalized AND p.won THEN 2520 // t.teams ELSE 0 END AS part
  FROM place p JOIN event e ON e.id = p.event_id LEFT JOIN tied t ON t.event_id = e.id
  WHERE p.player_id IS NOT NULL)"""
)


def _share(condition: str = "TRUE") -> str:
    total = f"coalesce(sum(CASE WHEN {condition} THEN part END), 0)"
    return f"CAST(CAST((200 * {total} + 2520) // 5040 AS BIGINT) / 100 AS DECIMAL(10,2))"


CAREER = f"""
career AS (
  SELECT p.id AS player_id, p.first_name || ' ' || p.last_name AS name,
         {_share()} AS career_wins, count(DISTINCT counted) AS events_played,
         {_share('is_major')} AS major_wins
  FROM player p LEFT JOIN entry ON player_id = p.id GROUP BY ALL)"""
BY_EVENT_NAME = f"""
career AS (
  SELECT p.id AS player_id, p.first_name || ' ' || p.last_name AS name, event_name,
         {_share()} AS career_wins, count(DISTINCT counted) AS events_played,
         {_share('is_major')} AS major_wins
  FROM player p LEFT JOIN entry ON player_id = p.id GROUP BY ALL)"""
BEST = "ORDER BY career_wins DESC, events_played DESC, name, player_id"


def _average(column: str) -> str:
    s, n = f"sum({column})", f"count({column})"
    return (
        f"CAST(CAST(sign({s}) * ((200 * abs({s}) + {n}) // (2 * {n})) AS BIGINT) / 100"
        " AS DECIMAL(10,2))"
    )


def _brief(where: str, order: str) -> str:
    return f"""SELECT e.id, e.name, e.date, e.course_id, e.season,
      k.name AS course_name, k.par AS course_par
    FROM event e LEFT JOIN course k ON k.id = e.course_id
    WHERE {where} ORDER BY {order} LIMIT 1"""


LATEST = _brief(f"e.date <= {AS_OF}", "e.date DESC, e.id DESC")
NEXT = _brief(f"e.date > {AS_OF}", "e.date, e.id")
TOP5 = """SELECT w.id, w.placement, w.strokes, w.relative AS to_par, {names}
    FROM wide w JOIN latest l ON l.id = w.event_id
    ORDER BY w.placement NULLS LAST, w.id LIMIT 5"""


def _finalized(n: int) -> str:
    return f"""recent AS (
  SELECT e.id, e.name, e.date, k.name AS course
  FROM event e LEFT JOIN course k ON k.id = e.course_id
  WHERE e.finalized ORDER BY e.date DESC, e.id DESC LIMIT {n})"""


PODIUM = """podium AS (
  SELECT w.event_id, r.name, r.date, r.course, w.id, w.placement, w.strokes, w.to_par,
         w.player_ids, w.team_name
  FROM recent r JOIN wide w ON w.event_id = r.id
  WHERE w.placement <= 3 AND NOT w.disqualified)"""
SNIPPET = """snippet AS (
  SELECT w.event_id, r.name, r.date, r.course, w.id, w.placement, w.strokes, w.to_par,
         w.player_ids, w.team_name
  FROM recent r JOIN wide w ON w.event_id = r.id WHERE NOT w.disqualified
  ORDER BY w.placement NULLS LAST, w.strokes NULLS LAST, w.id LIMIT 5)"""

EVENT = """e.id, e.name, e.date, e.course_id, e.is_team_event, e.notes, e.season, e.is_major,
  e.major_label, e.finalized"""
EVENT_ROWS = f"""SELECT {EVENT}, k.name AS course_name, k.par AS course_par
  FROM event e LEFT JOIN course k ON k.id = e.course_id"""
PLAYER = """id, first_name, last_name, nickname, hometown, debut_year, image_url, hof_inducted,
  hof_year, accolades, first_name || ' ' || last_name AS full_name"""

# The sheet rows of all scores; the sheet names an event by its id as well.
SHEET = (
    FULL
    + """,
sheet AS (SELECT w.* REPLACE (w.event_name || ' #' || w.event_id AS event_name), e.course_id
          FROM wide w JOIN event e ON e.id = w.event_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_id, p1, p2, p3, p4
                               ORDER BY placement NULLS LAST, strokes NULLS LAST,
                                        coalesce(notes, '')) AS nth
  FROM sheet),
staged AS (SELECT * FROM ranked WHERE nth = 1)"""
)
SHEET_COURSES = """sheet_course AS (
  SELECT * FROM course WHERE id IN (SELECT course_id FROM sheet))"""


# The sheet with faults planted in it, and why its rows are refused.
FAULTS = f"""{SHEET}, faults AS (
  SELECT event_name, date, season, n1 AS player1_full, strokes, placement, notes, list_filter([
    CASE WHEN notes <> 'wind F' THEN 'event_date: not date' END,
    CASE WHEN is_major AND event_id % 2 = 1 THEN 'is_major: not boolean' END,
    CASE WHEN strokes = 61 THEN 'strokes: not decimal(5,2)' END,
    CASE WHEN placement = 5 THEN 'placement: not int' END,
    CASE WHEN p4 IS NOT NULL THEN 'season: missing' END], lambda x: x IS NOT NULL) AS reasons
  FROM sheet)"""

LATE_CARDS = """touched AS (
  SELECT *, CASE WHEN disqualified THEN 99 ELSE strokes END AS now FROM wide)"""
LATE_COLUMNS = """CASE WHEN disqualified THEN now - course_par ELSE to_par END AS to_par,
  CASE WHEN NOT disqualified THEN placement END AS placement,
  CASE WHEN disqualified THEN 'DQ' ELSE notes END AS notes"""

MORE_COURSES = """more AS (
  SELECT id, name, city, state, par FROM course
  UNION ALL
  SELECT (SELECT max(id) FROM course) + row_number() OVER (
      ORDER BY last_name, hometown NULLS FIRST, nickname NULLS FIRST),
    last_name, hometown, nickname, 70 FROM player)"""


def _required(table: str, source: str, columns: dict[str, str]) -> list[str]:
    return [
        f"SELECT '{table}' AS \"table\", '{name}' AS \"column\","
        f" count(*) FILTER (WHERE {expr} IS NULL) AS rows FROM {source}"
        for name, expr in columns.items()
    ]


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


MISSING = " UNION ALL ".join(
    _required("players", "player", _same("first_name", "last_name"))
    + _required("courses", "course", _same("name", "par"))
    + _required(
        "events", "event",
        _same("name", "date", "course_id", "is_team_event", "season", "is_major", "finalized"),
    )
    + _required(
        "scores", "score",
        {"event_id": "event_id", "player1_id": "p1", "disqualified": "disqualified"},
    )
)


def _lengths(table: str, source: str, limits: dict[str, int]) -> list[str]:
    return [
        f"SELECT '{table}' AS \"table\", '{c}' AS \"column\","
        f" CAST(max(length({c})) AS INT) AS longest, {n} AS allowed,"
        f" coalesce(max(length({c})) <= {n}, TRUE) AS fits FROM {source}"
        for c, n in limits.items()
    ]


LENGTHS = " UNION ALL ".join(
    _lengths("players", "player",
             {"first_name": 50, "last_name": 50, "nickname": 50, "hometown": 100})
    + _lengths("courses", "course", {"name": 100, "city": 100, "state": 100})
    + _lengths("events", "event", {"name": 100, "major_label": 50})
)


def _orphaned(table: str, source: str, column: str, expr: str, kept: str) -> str:
    return (
        f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", {expr} AS id,"
        f" count(*) AS rows FROM {source} WHERE {expr} IS NOT NULL"
        f" AND {expr} NOT IN (SELECT id FROM {kept}) GROUP BY {expr}"
    )


ORPHANS = " UNION ALL ".join(
    [
        _orphaned("events", "(SELECT * FROM event WHERE finalized)", "course_id", "course_id",
                  "course WHERE state IS NOT NULL"),
        _orphaned("scores", "score", "event_id", "event_id", "event WHERE finalized"),
    ]
    + [
        _orphaned("scores", "score", f"player{i}_id", f"p{i}",
                  "player WHERE nickname IS NOT NULL")
        for i in (1, 2, 3, 4)
    ]
)

DASHED = "concat_ws('|', {})"


def _line(*columns: str) -> str:
    return DASHED.format(", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns))


ORACLES: dict[str, str] = {
    "career_wins": f"WITH {WINS}, {CAREER} SELECT * FROM career",
    "top_players": f"WITH {WINS}, {CAREER} SELECT * FROM career {BEST} LIMIT 10",
    "ranked_top_players": f"""WITH {WINS}, {CAREER},
      best AS (SELECT *, row_number() OVER ({BEST}) AS nth FROM career)
      SELECT CAST(nth AS INT) AS rank, player_id, name, CAST(career_wins AS VARCHAR) AS wins,
             CAST(major_wins AS VARCHAR) AS majors, events_played AS events
      FROM best WHERE nth <= 10""",
    "wins_by_event_name": f"WITH {WINS}, {BY_EVENT_NAME} SELECT * FROM career",
    "top_by_event_name": f"""WITH {WINS}, {BY_EVENT_NAME}
      SELECT * FROM career {BEST}, event_name NULLS LAST LIMIT 10""",
    "league_totals": f"""WITH {LEAGUE}, p AS (SELECT count(*) AS players FROM player)
      SELECT players, count(*) AS events, count(DISTINCT season) AS seasons
      FROM event, p GROUP BY players""",
    "latest_event": f"WITH {LEAGUE} {LATEST}",
    "next_event": f"WITH {LEAGUE} {NEXT}",
    "latest_event_top5": f"WITH {FULL}, latest AS ({LATEST}) {TOP5.format(names=NAMES)}",
    "home_summary": f"""WITH {FULL}, latest AS ({LATEST}), soon AS ({NEXT}),
      top5 AS ({TOP5.format(names=NAMES)})
      SELECT (SELECT count(*) FROM player) AS players, (SELECT count(*) FROM event) AS events,
        (SELECT count(DISTINCT season) FROM event) AS seasons,
        l.id AS latest_id, l.name AS latest_name, l.date AS latest_date,
        n.id AS next_id, n.name AS next_name, n.date AS next_date,
        CAST(row_number() OVER (ORDER BY t.placement NULLS LAST, t.id) - 1 AS INT) AS pos,
        t.id AS score_id, t.placement, t.strokes, t.to_par, t.player1_name
      FROM latest l, soon n, top5 t""",
    "upcoming_events": f"""WITH {LEAGUE}
      SELECT e.id, e.name, e.date, k.name AS course
      FROM event e LEFT JOIN course k ON k.id = e.course_id
      WHERE NOT e.finalized AND e.date >= {AS_OF} ORDER BY e.date, e.id LIMIT 3""",
    "latest_podiums": f"WITH {FULL}, {_finalized(3)}, {PODIUM} SELECT * FROM podium",
    "latest_podiums_hydrated": f"WITH {FULL}, {_finalized(5)}, {PODIUM} SELECT * FROM podium",
    "podium_documents": f"""WITH {FULL}, {_finalized(3)}, {PODIUM}
      SELECT event_id AS id, name, date, course, 0::BIGINT AS page,
        row_number() OVER (PARTITION BY event_id ORDER BY placement, podium.id) AS position,
        placement, strokes, to_par, player_ids, team_name FROM podium""",
    "leaderboard_snippet": f"WITH {FULL}, {_finalized(1)}, {SNIPPET} SELECT * FROM snippet",
    "leaderboard_snippet_outer": f"WITH {FULL}, {_finalized(1)}, {SNIPPET} SELECT * FROM snippet",
    "homepage": f"""WITH {FULL}, {_finalized(3)}, {PODIUM},
      newest AS (SELECT * FROM recent ORDER BY date DESC, id DESC LIMIT 1),
      {SNIPPET.replace("recent r", "newest r")},
      soon AS (SELECT e.id, e.name, e.date, k.name AS course
        FROM event e LEFT JOIN course k ON k.id = e.course_id
        WHERE NOT e.finalized AND e.date >= {AS_OF} ORDER BY e.date, e.id LIMIT 3),
      {WINS.removeprefix(LEAGUE + ",")}, {CAREER},
      best AS (SELECT * FROM career {BEST} LIMIT 10)
      SELECT 'upcoming' AS section, CAST(row_number() OVER (ORDER BY date, id) - 1 AS INT) AS pos,
        0 AS sub, id, name, {_line('date', 'course')} AS detail FROM soon
      UNION ALL
      SELECT 'podium', CAST(dense_rank() OVER (ORDER BY date DESC, event_id DESC) - 1 AS INT),
        CAST(row_number() OVER (PARTITION BY event_id ORDER BY placement, id) - 1 AS INT),
        event_id, team_name, {_line('placement', 'strokes', 'to_par')} FROM podium
      UNION ALL
      SELECT 'snippet',
        CAST(row_number() OVER (ORDER BY placement NULLS LAST, strokes NULLS LAST, id) - 1 AS INT),
        0, event_id, team_name, {_line('placement', 'strokes', 'to_par')} FROM snippet
      UNION ALL
      SELECT 'players', CAST(row_number() OVER ({BEST}) - 1 AS INT), 0, player_id, name,
        {_line('career_wins', 'events_played', 'major_wins')} FROM best""",
    "event_list": f"WITH {LEAGUE} {EVENT_ROWS}",
    "event_list_with_location": f"""WITH {LEAGUE}
      SELECT {EVENT}, k.name AS course_name, k.city || ', ' || k.state AS course_location,
        k.par AS course_par
      FROM event e LEFT JOIN course k ON k.id = e.course_id""",
    "events_by_id": f"""WITH {LEAGUE}, listed AS ({EVENT_ROWS})
      SELECT w.id, l.* EXCLUDE (id), l.id IS NOT NULL AS found
      FROM (SELECT DISTINCT event_id AS id FROM score) w LEFT JOIN listed l ON l.id = w.id""",
    "event_scores": f"""WITH {FULL}
      SELECT id, event_id, p1 AS player1_id, p2 AS player2_id, p3 AS player3_id,
        p4 AS player4_id, {NAMES}, strokes, relative AS to_par, placement, disqualified
      FROM wide""",
    "event_places": f"""WITH {FULL}
      SELECT id, event_id, p1 AS player1_id, p2 AS player2_id, p3 AS player3_id,
        p4 AS player4_id, {NAMES}, strokes, relative AS to_par, placement, disqualified,
        row_number() OVER (PARTITION BY event_id ORDER BY placement NULLS LAST, relative NULLS LAST,
                           strokes NULLS LAST, id) AS line
      FROM wide""",
    "event_with_teams": f"""WITH {FULL}
      SELECT e.id, e.name, k.city || ', ' || k.state AS course_location, k.par AS course_par,
        0::BIGINT AS page,
        CASE WHEN w.id IS NOT NULL THEN row_number() OVER (PARTITION BY e.id ORDER BY w.id) END
          AS position,
        w.id AS score_id, w.strokes, w.placement, w.notes,
        n1 AS player1, n2 AS player2, n3 AS player3, n4 AS player4
      FROM event e LEFT JOIN course k ON k.id = e.course_id LEFT JOIN wide w ON w.event_id = e.id""",
    "player_list": f"WITH {LEAGUE} SELECT {PLAYER} FROM player",
    "players_by_id": f"""WITH {LEAGUE}, listed AS (SELECT {PLAYER} FROM player)
      SELECT w.id, l.* EXCLUDE (id), l.id IS NOT NULL AS found
      FROM (SELECT DISTINCT event_id AS id FROM score) w LEFT JOIN listed l ON l.id = w.id""",
    "player_stats": f"""WITH {FULL},
      slot AS (SELECT w.*, unnest([p1, p2, p3, p4]) AS player_id FROM wide w),
      entry AS (SELECT DISTINCT ON (id, player_id) * FROM slot WHERE player_id IS NOT NULL)
      SELECT p.id AS player_id, count(DISTINCT event_id) AS events_played,
        count(*) FILTER (WHERE placement = 1) AS events_won,
        count(*) FILTER (WHERE placement <= 3) AS podiums, min(placement) AS best_finish,
        {_average('strokes')} AS avg_strokes, {_average('relative')} AS avg_to_par,
        min(date) AS first_event_date, max(date) AS last_event_date,
        count(DISTINCT season) AS seasons_played
      FROM player p LEFT JOIN entry x ON x.player_id = p.id GROUP BY p.id""",
    "player_results": f"""WITH {FULL},
      slot AS (SELECT w.*, unnest(list_distinct([p1, p2, p3, p4])) AS player_id FROM wide w)
      SELECT player_id, event_id, event_name, date, season, course_name, course_par,
        id AS score_id, placement, strokes, relative AS to_par, {NAMES}
      FROM slot WHERE player_id IS NOT NULL""",
    "player_scores": f"""WITH {FULL},
      slot AS (SELECT w.*, unnest(list_distinct([p1, p2, p3, p4])) AS player_id FROM wide w)
      SELECT player_id, id, event_id, p1 AS player1_id, p2 AS player2_id, p3 AS player3_id,
        p4 AS player4_id, strokes, to_par, placement, notes, disqualified, event_name,
        date AS event_date, {STRICT_NAMES}
      FROM slot WHERE player_id IS NOT NULL""",
    "score_list": f"""WITH {FULL}
      SELECT id, event_id, event_name, date, strokes, placement, notes, {STRICT_NAMES}
      FROM wide""",
    "course_list": f"WITH {LEAGUE} SELECT * FROM course",
    "courses_by_id": f"""WITH {LEAGUE}
      SELECT w.id, k.name, k.city, k.state, k.par, k.id IS NOT NULL AS found
      FROM (SELECT DISTINCT p1 AS id FROM score) w LEFT JOIN course k ON k.id = w.id""",
    "hydrated_names": f"""WITH {LEAGUE},
      slot AS (SELECT id, unnest([p1, p2, p3, p4]) AS pid, unnest([1, 2, 3, 4]) AS pos FROM score),
      shown AS (
        SELECT s.id, s.pos, s.pid,
          CASE WHEN p.id IS NULL THEN 'Player #' || s.pid
               ELSE left(p.first_name, 1) || '. ' || p.last_name END AS label
        FROM slot s LEFT JOIN player p ON p.id = s.pid AND NOT p.hof_inducted
        WHERE s.pid IS NOT NULL)
      SELECT id, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pos) AS player_ids,
        string_agg(label, ' / ' ORDER BY pos) AS names FROM shown GROUP BY id""",
    "event_labels": f"""WITH {LEAGUE}
      SELECT e.id, strftime(e.date, '%b %-d, %Y') AS date_label,
        k.name || ' (Par ' || k.par || ')' AS course_label, k.name AS course, k.name AS venue,
        CASE WHEN e.is_major THEN coalesce(e.major_label, 'Major Tournament') END
          AS major_title, e.name AS title, strftime(e.date, '%b %-d, %Y') AS shown_date
      FROM event e JOIN course k ON k.id = e.course_id""",
    "labels_without_courses": f"""WITH {LEAGUE}
      SELECT e.id, CASE WHEN k.par <> 71 THEN k.name || ' (Par ' || k.par || ')'
                        ELSE 'Course #' || k.id END AS course_label,
        CASE WHEN k.par <> 71 THEN k.name ELSE 'Unknown Course' END AS course,
        CASE WHEN k.par <> 71 THEN k.name ELSE 'TBD' END AS venue
      FROM event e JOIN course k ON k.id = e.course_id""",
    "player_labels": f"""WITH {LEAGUE}
      SELECT id, first_name || ' ' || last_name || coalesce(' (“' || nickname || '”)', '') AS title,
        concat_ws(' · ', hometown, 'Debut ' || debut_year) AS line,
        hometown || ' · ' || coalesce('Debut ' || debut_year, '')
          || CASE WHEN hof_inducted THEN ' · Hall of Fame' ELSE '' END AS detail_line
      FROM player""",
    "score_labels": f"""WITH {FULL}
      SELECT id, event_id,
        CASE placement WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉'
             ELSE '#' || placement END AS medal,
        coalesce(CAST(placement AS VARCHAR), '—') AS place,
        concat_ws(' / ', n1, n2, n3, n4) AS team, concat_ws(', ', n1, n2, n3, n4) AS members,
        concat_ws(' / ', n1, n2, n3, n4) AS linked_members,
        coalesce(CAST(strokes AS VARCHAR), '—') AS strokes_label,
        CASE WHEN relative IS NULL THEN '—' WHEN relative = 0 THEN 'E'
             WHEN relative > 0 THEN '+' || relative ELSE CAST(relative AS VARCHAR) END
          AS to_par_label
      FROM wide""",
    "distinct_raw_names": f"""WITH {SHEET}
      SELECT DISTINCT raw_full
      FROM (SELECT unnest([n1, n2, n3, n4]) AS raw_full FROM sheet) WHERE raw_full IS NOT NULL""",
    "insert_courses": f"""WITH {SHEET}, {SHEET_COURSES},
      known AS (SELECT * FROM course WHERE par = 72)
      SELECT * FROM known
      UNION ALL
      SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY name) AS id,
        name, city, state, par
      FROM sheet_course WHERE name NOT IN (SELECT name FROM known)""",
    "update_course_par": f"""WITH {SHEET}, {SHEET_COURSES}
      SELECT c.id, c.name, c.city, c.state, coalesce(s.par, 72) AS par
      FROM course c LEFT JOIN sheet_course s ON s.id = c.id""",
    "insert_players": f"""WITH {LEAGUE}, known AS (SELECT * FROM player WHERE hof_inducted)
      SELECT id, first_name, last_name, hometown FROM known
      UNION ALL
      SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY first_name, last_name),
        first_name, last_name, NULL
      FROM player WHERE NOT hof_inducted""",
    "upsert_events": f"""WITH {SHEET},
      kept AS (SELECT * REPLACE (name || ' #' || id AS name) FROM event),
      told AS (SELECT DISTINCT event_id FROM sheet)
      SELECT id, name, date, course_id, 'kept' AS notes,
        CASE WHEN event_id IS NULL THEN 0 ELSE season END AS season, is_major,
        event_id IS NOT NULL AS finalized
      FROM kept LEFT JOIN told ON event_id = id WHERE finalized
      UNION ALL
      SELECT (SELECT max(id) FROM kept WHERE finalized)
          + row_number() OVER (ORDER BY name, date, course_id),
        name, date, course_id, NULL, season, is_major, FALSE
      FROM kept JOIN told ON event_id = id WHERE NOT finalized""",
    "resolve_names": f"""WITH {LEAGUE}
      SELECT first_name || ' ' || last_name AS raw_full,
        CASE WHEN hof_inducted THEN id END AS player_id FROM player""",
    "insert_scores": f"""WITH {SHEET},
      known AS (SELECT * FROM score WHERE placement = 1),
      fresh AS (SELECT * FROM staged s WHERE NOT EXISTS (
        SELECT 1 FROM known k WHERE k.event_id = s.event_id AND k.p1 = s.p1
          AND k.p2 IS NOT DISTINCT FROM s.p2 AND k.p3 IS NOT DISTINCT FROM s.p3
          AND k.p4 IS NOT DISTINCT FROM s.p4))
      SELECT id, event_id, p1 AS player1_id, p2 AS player2_id, p3 AS player3_id,
        p4 AS player4_id, strokes, to_par, placement, 'known' AS notes, disqualified
      FROM known
      UNION ALL
      SELECT (SELECT max(id) FROM known) + row_number() OVER (
          ORDER BY event_id, p1, coalesce(p2, 0), coalesce(p3, 0), coalesce(p4, 0)),
        event_id, p1, p2, p3, p4, strokes, NULL, placement, notes,
        strokes IS NULL OR coalesce(notes, '') ILIKE '%dq%'
      FROM fresh""",
    "refresh_to_par": f"""WITH {FULL}
      SELECT id, strokes, coalesce(strokes - course_par, to_par) AS to_par FROM wide""",
    "load_from_staging": f"""WITH {SHEET}
      SELECT event_name, date, season, course_name, finalized, {NAMES}, strokes,
        strokes - course_par AS to_par, placement,
        strokes IS NULL OR coalesce(notes, '') ILIKE '%dq%' AS disqualified
      FROM staged""",
    "csv_sheet": f"""WITH {SHEET}
      SELECT s.season, s.date AS event_date, s.event_name, k.name AS course_name,
        k.city AS course_city, k.state AS course_state, k.par AS course_par, e.is_team_event,
        e.is_major, e.major_label, e.finalized, n1 AS player1_full, n2 AS player2_full,
        n3 AS player3_full, n4 AS player4_full, CAST(s.strokes AS DECIMAL(5,2)) AS strokes,
        s.placement, s.notes
      FROM sheet s JOIN event e ON e.id = s.event_id JOIN course k ON k.id = e.course_id""",
    "sheet_rejects": f"""WITH {FAULTS}
      SELECT event_name, player1_full, array_to_string(reasons, '; ') AS reasons FROM faults WHERE len(reasons) > 0""",
    "sheet_accepted": f"""WITH {FAULTS}
      SELECT event_name, date AS event_date, season, player1_full, CAST(strokes AS DECIMAL(5,2)) AS strokes,
        placement, notes FROM faults WHERE len(reasons) = 0""",
    "csv_name_map": f"""WITH {LEAGUE}
      SELECT first_name || ' ' || last_name AS raw_full, first_name, last_name FROM player""",
    "csv_backup": f"""WITH {LEAGUE}
      SELECT id, event_id, p1 AS player1_id, p2 AS player2_id, p3 AS player3_id,
        p4 AS player4_id, strokes, to_par, placement, notes, disqualified FROM score""",
    "saved_tables": f"WITH {LEAGUE} SELECT * FROM event",
    "stored_changes": f"""WITH {FULL}, {LATE_CARDS}
      SELECT id, event_id, now AS strokes, {LATE_COLUMNS} FROM touched WHERE finalized""",
    "conflicting_changes": f"""WITH {LEAGUE}, {MORE_COURSES}
      SELECT id, name, city, coalesce(state, 'WI') AS state,
        CASE WHEN state IS NULL THEN par + 1 ELSE par END AS par FROM more""",
    "duplicate_player_keys": f"""WITH {LEAGUE}
      SELECT first_name, hometown AS last_name, count(*) AS rows
      FROM player GROUP BY ALL HAVING count(*) > 1""",
    "duplicate_raw_names": f"""WITH {LEAGUE}
      SELECT first_name AS raw_full, count(*) AS rows
      FROM player GROUP BY ALL HAVING count(*) > 1""",
    "insert_course_rows": f"WITH {LEAGUE}, {MORE_COURSES} SELECT * FROM more",
    "insert_event_rows": f"""WITH {LEAGUE}
      SELECT id, name, date, course_id, season, is_team_event, is_major, finalized FROM event
      UNION ALL
      SELECT (SELECT max(id) FROM event) + row_number() OVER (ORDER BY name, id), 'Opening of ' || name,
        {AS_OF}, id, 1999, TRUE, FALSE, FALSE FROM course""",
    "insert_score_rows": f"""WITH {LEAGUE}
      SELECT id, event_id, p1 AS player1_id, p2 AS player2_id, p3 AS player3_id, p4 AS player4_id,
        strokes, placement, disqualified FROM score
      UNION ALL
      SELECT (SELECT max(id) FROM score) + row_number() OVER (ORDER BY id), id, 1, 2, 3, 4, 70, NULL, FALSE
      FROM event""",
    "delete_players": f"""WITH {LEAGUE}
      SELECT id, last_name FROM player
      WHERE id IN (SELECT unnest([p1, p2, p3, p4]) FROM score)""",
    "delete_players_in_use": f"""WITH {LEAGUE}, famous AS (SELECT id FROM player WHERE hof_inducted)
      SELECT id, p1 AS player1_id,
        {', '.join(f"CASE WHEN p{i} NOT IN (SELECT id FROM famous) THEN p{i} END AS player{i}_id" for i in (2, 3, 4))}
      FROM score WHERE p1 NOT IN (SELECT id FROM famous)""",
    "delete_courses": f"WITH {LEAGUE} SELECT * FROM course WHERE id IN (SELECT course_id FROM event)",
    "duplicate_course_keys": f"""WITH {LEAGUE}
      SELECT city AS name, city, coalesce(state, '') AS state, count(*) AS rows
      FROM course GROUP BY ALL HAVING count(*) > 1""",
    "duplicate_event_keys": f"""WITH {LEAGUE}
      SELECT name, date, course_id, count(*) AS rows FROM event GROUP BY ALL HAVING count(*) > 1""",
    "duplicate_team_keys": f"""WITH {LEAGUE}
      SELECT event_id, coalesce(p1, 0) AS player1_id, coalesce(p2, 0) AS player2_id,
        coalesce(p3, 0) AS player3_id, coalesce(p4, 0) AS player4_id, count(*) AS rows
      FROM score GROUP BY ALL HAVING count(*) > 1""",
    "orphans": f"WITH {LEAGUE} {ORPHANS}",
    "missing_values": f"WITH {LEAGUE} {MISSING}",
    "text_lengths": f"WITH {LEAGUE} {LENGTHS}",
    "players_in_use": f"""WITH {LEAGUE}
      SELECT DISTINCT id FROM (SELECT unnest([p1, p2, p3, p4]) AS id FROM score)
      WHERE id IS NOT NULL""",
    "courses_in_use": f"WITH {LEAGUE} SELECT DISTINCT course_id AS id FROM event",
    "delete_open_events": f"WITH {FULL} SELECT id, event_id FROM wide WHERE finalized",
    "update_scores": f"""WITH {FULL}, {LATE_CARDS}
      SELECT id, now AS strokes, {LATE_COLUMNS}, disqualified FROM touched""",
    "update_players": f"""WITH {LEAGUE}
      SELECT id, first_name, last_name,
        CASE WHEN hof_inducted THEN upper(hometown) ELSE nickname END AS nickname,
        CASE WHEN hof_inducted THEN 2000 END AS hof_year FROM player""",
    "update_courses": f"""WITH {LEAGUE}
      SELECT id, name, city, coalesce(state, 'WI') AS state,
        CASE WHEN state IS NULL THEN par + 1 ELSE par END AS par FROM course""",
    "insert_player_rows": f"""WITH {LEAGUE}
      SELECT id, first_name, last_name, hometown, hof_inducted FROM player
      UNION ALL
      SELECT (SELECT max(id) FROM player) + row_number() OVER (ORDER BY name), name, city,
        state, FALSE FROM course""",
    "delete_scores": f"WITH {LEAGUE} SELECT id, event_id FROM score WHERE NOT disqualified",
    "not_found": f"""WITH {LEAGUE}
      SELECT DISTINCT event_id AS id FROM score WHERE event_id NOT IN (SELECT id FROM player)""",
}

# The same about one player, and the same rows by way of JSON.
for _name in ("stats", "results", "scores"):
    ORACLES[f"one_player_{_name}"] = (
        f"SELECT * FROM ({ORACLES[f'player_{_name}']}) WHERE player_id = 7"
    )
ORACLES["json_documents"] = ORACLES["event_with_teams"]
