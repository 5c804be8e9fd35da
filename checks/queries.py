"""The registered queries: every operator over the driver's whole tables.

Nested results are laid out flat, and arrays joined to text, so that they can be
compared with SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clubhouse.binding import AS_OF, bound_name_map, bound_sheet, bound_tables, sheet_events
from clubhouse.functions.names import player_ids
from clubhouse.operators import changes, load, quality
from clubhouse.operators.slots import hydrate_names
from clubhouse.plans import (
    courses,
    events,
    homepage,
    leaderboards,
    players,
    presentation,
    wins,
)
from clubhouse.schemas import LENIENT_REFERENCES, SLOT_IDS, SLOT_NAMES
from clubhouse.session import shared_path
from clubhouse.sources import files, store
from clubhouse.tables import Tables, conform, empty_tables

# Teams on a page of a nested document.
PAGE = 10_000
# Sheets and documents repeat much text. A file is what one task wrote, so that one can read it.
COMPRESSION = "gzip"
# The player of the queries about one player.
ONE_PLAYER = 7

Query = Callable[[Tables], DataFrame]


def _ids_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("player_ids", F.array_join("player_ids", ","))


# -- reports ---------------------------------------------------------------


def _home_summary(t: Tables) -> DataFrame:
    summary = homepage.home_summary(t, AS_OF)
    rows = summary.select(
        "totals.*",
        *[F.col(f"latest_event.{c}").alias(f"latest_{c}") for c in ("id", "name", "date")],
        *[F.col(f"next_event.{c}").alias(f"next_{c}") for c in ("id", "name", "date")],
        F.posexplode_outer("latest_event.top_results").alias("pos", "result"),
    )
    kept = [c for c in rows.columns if c != "result"]
    return rows.select(*kept, F.col("result.id").alias("score_id"), "result.placement",
                       "result.strokes", "result.to_par", "result.player1_name")


def _podium_documents(t: Tables) -> DataFrame:
    rows = leaderboards.podium_documents(t, PAGE).select(
        "id", "name", "date", "course", "page", F.posexplode("podium").alias("pos", "p")
    )
    return rows.select(
        "id", "name", "date", "course", "page", _position().alias("position"),
        "p.placement", "p.strokes",
        F.col("p.toPar").alias("to_par"),
        F.array_join("p.playerIds", ",").alias("player_ids"),
        F.col("p.teamName").alias("team_name"),
    )


def _position() -> Column:
    return F.col("page") * PAGE + F.col("pos") + 1


def _homepage(t: Tables) -> DataFrame:
    def line(*values: Column) -> Column:
        texts = [F.coalesce(v.cast("string"), F.lit("-")) for v in values]
        return F.concat_ws("|", *texts)

    def row(section: str, pos, sub, id, name, detail) -> Column:
        return F.struct(
            F.lit(section).alias("section"), pos.alias("pos"), sub.alias("sub"), id.alias("id"),
            name.alias("name"), detail.alias("detail"),
        )

    none = F.lit(0)

    def result(section: str, pos, sub, id, r) -> Column:
        return row(section, pos, sub, id, r.teamName, line(r.placement, r.strokes, r.toPar))

    snippet = F.col("leaderboardSnippet")
    page = homepage.homepage(t, AS_OF, PAGE).select(
        F.concat(
            F.transform(
                "upcomingEvents",
                lambda e, i: row("upcoming", i, none, e.id, e["name"], line(e.date, e.course)),
            ),
            F.flatten(
                F.transform(
                    "latestEvents",
                    lambda e, i: F.transform(
                        e.podium, lambda p, j: result("podium", i, j, e.id, p)
                    ),
                )
            ),
            F.transform(
                snippet.getField("rows"),
                lambda r, i: result("snippet", i, none, snippet.event.id, r),
            ),
            F.transform(
                "topPlayers",
                lambda b, i: row(
                    "players", i, none, b.player_id, b["name"],
                    line(b.career_wins, b.events_played, b.major_wins),
                ),
            ),
        ).alias("rows")
    )
    return page.select(F.inline("rows"))


def _event_with_teams(t: Tables) -> DataFrame:
    return _team_lines(leaderboards.event_with_teams(t, PAGE))


def _team_lines(documents: DataFrame) -> DataFrame:
    rows = documents.select(
        "id", "name", "course_location", "course_par", "page",
        F.posexplode_outer("teams").alias("pos", "team"),
    )
    return rows.select(
        "id", "name", "course_location", "course_par", "page", _position().alias("position"),
        F.col("team.id").alias("score_id"),
        *[f"team.{c}" for c in ("strokes", "placement", "notes",
                                "player1", "player2", "player3", "player4")],
    )


def _hydrated_names(t: Tables) -> DataFrame:
    rows = t.scores.select("id", player_ids(*SLOT_IDS).alias("player_ids"))
    # Players of the hall of fame are taken out, so their ids have no name.
    others = t.with_tables(players=t.players.where("NOT hof_inducted"))
    return _ids_as_text(hydrate_names(rows, others, ["id"]))


# -- load ------------------------------------------------------------------


@lru_cache(maxsize=4)
def _sheet(t: Tables) -> DataFrame:
    """The bound tables as a staged sheet, staged once per session."""
    return load.stage(bound_sheet(t))


def _insert_courses(t: Tables) -> DataFrame:
    return load.insert_courses(t.courses.where("par = 72"), _sheet(t))


def _update_course_par(t: Tables) -> DataFrame:
    return load.update_course_par(t.courses.withColumn("par", F.lit(72)), _sheet(t))


def _insert_players(t: Tables) -> DataFrame:
    known = t.players.where("hof_inducted")
    return load.insert_players(known, bound_name_map(t)).select(
        "id", "first_name", "last_name", "hometown"
    )


def _upsert_events(t: Tables) -> DataFrame:
    known = (
        sheet_events(t)
        .where("finalized")
        .withColumns({"finalized": F.lit(False), "season": F.lit(0), "notes": F.lit("kept")})
    )
    return load.upsert_events(_sheet(t), t.with_tables(events=known)).select(
        "id", "name", "date", "course_id", "notes", "season", "is_major", "finalized"
    )


def _insert_scores(t: Tables) -> DataFrame:
    known = t.with_tables(
        events=sheet_events(t), scores=t.scores.where("placement = 1").drop("notes")
    )
    known = known.with_tables(scores=known.scores.withColumn("notes", F.lit("known")))
    return load.insert_scores(_sheet(t), bound_name_map(t), known)


def _load_from_staging(t: Tables) -> DataFrame:
    loaded = load.load_from_staging(_sheet(t), bound_name_map(t), empty_tables(t.spark))
    board = leaderboards.event_scores(loaded, ordered=False)
    about = events.event_list(loaded, ordered=False).select(
        F.col("id").alias("event_id"), F.col("name").alias("event_name"), "date", "season",
        "course_name", "finalized",
    )
    return board.join(about, "event_id").select(
        "event_name", "date", "season", "course_name", "finalized", *SLOT_NAMES,
        "strokes", "to_par", "placement", "disqualified",
    )


# -- sources -----------------------------------------------------------------


def _csv_sheet(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "sheet")
    files.write_csv(bound_sheet(t), path, compression=COMPRESSION)
    return files.read_results(t.spark, path)


def _csv_name_map(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "names")
    files.write_csv(bound_name_map(t), path)
    return files.read_name_map(t.spark, path)


def _csv_backup(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "backup")
    files.write_csv(t.scores, path, short_flags=True)
    return files.read_backup(t.spark, "scores", path)


def _saved_tables(t: Tables) -> DataFrame:
    root = shared_path(t.spark, "league")
    store.save_tables(t, root)
    return store.load_tables(t.spark, root).events


def _sheet_with_faults(t: Tables) -> DataFrame:
    """The sheet as text, with values that are none and values left out."""
    text = bound_sheet(t)
    text = text.select(*[F.col(c).cast("string").alias(c) for c in text.columns])
    return text.withColumns(
        {
            "strokes": F.when(F.col("strokes") == "61.00", "sixty-one").otherwise(F.col("strokes")),
            "placement": F.when(F.col("placement") == "5", "5th").otherwise(F.col("placement")),
            "is_major": F.when(F.col("major_label").isNotNull(), "yes").otherwise(F.col("is_major")),
            "event_date": F.when(F.col("notes") != "wind F", F.date_format("event_date", "dd.MM.yyyy")).otherwise(
                F.col("event_date")
            ),
            "season": F.when(F.col("player4_full").isNull(), F.col("season")),
        }
    )


def _sheet_rejects(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "faults")
    files.write_csv(_sheet_with_faults(t), path, compression=COMPRESSION)
    _, rejects = files.read_results_checked(t.spark, path)
    return rejects.select("event_name", "player1_full", F.array_join("reasons", "; ").alias("reasons"))


def _sheet_accepted(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "faults")
    files.write_csv(_sheet_with_faults(t), path, compression=COMPRESSION)
    good, _ = files.read_results_checked(t.spark, path)
    return good.select("event_name", "event_date", "season", "player1_full", "strokes", "placement", "notes")


def _stored_changes(t: Tables) -> DataFrame:
    """Two change sets, each saved as a version of its own."""
    root = shared_path(t.spark, "league")
    store.save_tables(t, root)
    store.commit(t.spark, root, lambda now: changes.update_rows(now, "scores", _late_cards(now), refresh=True).tables)
    store.commit(
        t.spark, root, lambda now: changes.delete_rows(now, "events", now.events.where("NOT finalized")).tables
    )
    return store.load_tables(t.spark, root).scores.select("id", "event_id", "strokes", "to_par", "placement", "notes")


def _conflicting_changes(t: Tables) -> DataFrame:
    """Two savers of one version: the second one's change goes onto the first one's."""
    root = shared_path(t.spark, "league")
    store.save_tables(t, root)
    mine = store.load_tables(t.spark, root)
    store.commit(t.spark, root, lambda now: changes.insert_rows(now, "courses", _player_courses(now)).tables)

    def states(now: Tables) -> Tables:
        return changes.update_rows(now, "courses", _without_state(now)).tables

    try:
        store.save_tables(states(mine), root)
    except store.VersionConflict:
        store.commit(t.spark, root, states)
    return store.load_tables(t.spark, root).courses


def _json_documents(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "documents")
    documents = leaderboards.event_with_teams(t, PAGE)
    files.write_documents(documents, path, compression=COMPRESSION)
    return _team_lines(files.read_documents(t.spark, path, documents.schema))


# -- integrity and changes ---------------------------------------------------


def _orphans(t: Tables) -> DataFrame:
    """References that would break if only some rows were kept."""
    return quality.orphans(
        t.with_tables(
            events=t.events.where("finalized"),
            courses=t.courses.where("state IS NOT NULL"),
            players=t.players.where("nickname IS NOT NULL"),
        )
    )


def _delete_open_events(t: Tables) -> DataFrame:
    open_events = t.events.where("NOT finalized")
    after = changes.delete_rows(t, "events", open_events).tables
    return after.scores.select("id", "event_id")


def _late_cards(t: Tables) -> DataFrame:
    return t.scores.where("disqualified").select(
        "id", F.lit(99).alias("strokes"), F.lit(None).cast("int").alias("placement"),
        F.lit("DQ").alias("notes"),
    )


def _update_scores(t: Tables) -> DataFrame:
    after = changes.update_rows(t, "scores", _late_cards(t), refresh=True).tables
    return after.scores.select("id", "strokes", "to_par", "placement", "notes", "disqualified")


def _update_players(t: Tables) -> DataFrame:
    new = t.players.where("hof_inducted").withColumns(
        {"hof_year": F.lit(2000), "nickname": F.upper("hometown")}
    )
    after = changes.update_rows(t, "players", new).tables
    return after.players.select("id", "first_name", "last_name", "nickname", "hof_year")


def _without_state(t: Tables) -> DataFrame:
    return t.courses.where("state IS NULL").withColumns({"state": F.lit("WI"), "par": F.col("par") + 1})


def _update_courses(t: Tables) -> DataFrame:
    return changes.update_rows(t, "courses", _without_state(t)).tables.courses


def _insert_player_rows(t: Tables) -> DataFrame:
    rows = t.courses.select(
        F.col("name").alias("first_name"), F.col("city").alias("last_name"),
        F.col("state").alias("hometown"),
    )
    after = changes.insert_rows(t, "players", rows).tables
    return after.players.select("id", "first_name", "last_name", "hometown", "hof_inducted")


def _player_courses(t: Tables) -> DataFrame:
    return t.players.select(
        F.col("last_name").alias("name"), F.col("hometown").alias("city"),
        F.col("nickname").alias("state"), F.lit(70).alias("par"),
    )


def _insert_course_rows(t: Tables) -> DataFrame:
    return changes.insert_rows(t, "courses", _player_courses(t)).tables.courses


def _insert_event_rows(t: Tables) -> DataFrame:
    rows = t.courses.select(
        F.concat(F.lit("Opening of "), "name").alias("name"), F.lit(AS_OF).alias("date"),
        F.col("id").alias("course_id"), F.lit(AS_OF.year).alias("season"),
    )
    after = changes.insert_rows(t, "events", rows).tables
    return after.events.select("id", "name", "date", "course_id", "season", "is_team_event", "is_major", "finalized")


def _insert_score_rows(t: Tables) -> DataFrame:
    """A team of the first four players in every event."""
    team = {slot: F.lit(i).cast("long") for i, slot in enumerate(SLOT_IDS, 1)}
    rows = t.events.select(F.col("id").alias("event_id"), *[v.alias(c) for c, v in team.items()],
                           F.lit(70).alias("strokes"))
    after = changes.insert_rows(t, "scores", rows).tables
    return after.scores.select("id", "event_id", *SLOT_IDS, "strokes", "placement", "disqualified")


def _delete_players_in_use(t: Tables) -> DataFrame:
    """Players of the hall of fame go: their teams too if they come first in them.

    A team key that only differed in an emptied slot would be refused, so every
    score is an event of its own here.
    """
    apart = t.with_tables(
        scores=t.scores.withColumn("event_id", F.col("id")), events=conform(t.scores.select("id"), "events")
    )
    famous = apart.players.where("hof_inducted")
    after = changes.delete_rows(apart, "players", famous, LENIENT_REFERENCES).tables
    return after.scores.select("id", *SLOT_IDS)


def _delete_courses(t: Tables) -> DataFrame:
    used = quality.rows_in_use(t, "courses", t.courses)
    unused = t.courses.select("id").join(used, "id", "left_anti")
    return changes.delete_rows(t, "courses", unused).tables.courses


def _labels_without_courses(t: Tables) -> DataFrame:
    """Labels where a course is not in the table."""
    return presentation.event_labels(t.with_tables(courses=t.courses.where("par <> 71"))).select(
        "id", "course_label", "course", "venue"
    )


def _unused_players(t: Tables) -> DataFrame:
    used = quality.rows_in_use(t, "players", t.players)
    return t.players.select("id").join(used, "id", "left_anti")


def _delete_players(t: Tables) -> DataFrame:
    return changes.delete_rows(t, "players", _unused_players(t)).tables.players.select("id", "last_name")


def _delete_scores(t: Tables) -> DataFrame:
    gone = t.scores.where("disqualified")
    return changes.delete_rows(t, "scores", gone).tables.scores.select("id", "event_id")


def _not_found(t: Tables) -> DataFrame:
    wanted = t.scores.select(F.col("event_id").alias("id"))
    return changes.not_found(t.players, wanted)


QUERIES: dict[str, Query] = {
    "career_wins": wins.career_wins,
    "top_players": wins.top_players,
    "ranked_top_players": wins.ranked_top_players,
    "wins_by_event_name": wins.wins_by_event_name,
    "top_by_event_name": wins.top_by_event_name,
    "league_totals": homepage.league_totals,
    "latest_event": lambda t: events.latest_event(t, AS_OF),
    "next_event": lambda t: events.next_event(t, AS_OF),
    "latest_event_top5": lambda t: leaderboards.latest_event_top(t, AS_OF),
    "home_summary": _home_summary,
    "upcoming_events": lambda t: events.upcoming_events(t, AS_OF),
    "latest_podiums": lambda t: _ids_as_text(leaderboards.latest_podiums(t)),
    "latest_podiums_hydrated": lambda t: _ids_as_text(leaderboards.latest_podiums_hydrated(t)),
    "podium_documents": _podium_documents,
    "leaderboard_snippet": lambda t: _ids_as_text(leaderboards.leaderboard_snippet(t)),
    "leaderboard_snippet_outer": lambda t: _ids_as_text(
        leaderboards.leaderboard_snippet_outer(t)
    ),
    "homepage": _homepage,
    "event_list": events.event_list,
    "event_list_with_location": events.event_list_with_location,
    "events_by_id": lambda t: events.with_ids(
        events.event_list(t, ordered=False), t.scores.select(F.col("event_id").alias("id"))
    ),
    "event_scores": leaderboards.event_scores,
    "event_places": leaderboards.event_places,
    "event_with_teams": _event_with_teams,
    "player_list": players.player_list,
    "players_by_id": lambda t: events.with_ids(
        players.player_list(t, ordered=False), t.scores.select(F.col("event_id").alias("id"))
    ),
    "player_stats": players.player_stats,
    "player_results": players.player_results,
    "player_scores": players.player_scores,
    "score_list": leaderboards.score_list,
    "course_list": courses.course_list,
    "courses_by_id": lambda t: events.with_ids(
        courses.course_list(t, ordered=False), t.scores.select(F.col("player1_id").alias("id"))
    ),
    "hydrated_names": _hydrated_names,
    "event_labels": presentation.event_labels,
    "labels_without_courses": _labels_without_courses,
    "score_labels": presentation.score_labels,
    "player_labels": presentation.player_labels,
    "distinct_raw_names": lambda t: load.distinct_raw_names(bound_sheet(t)),
    "insert_courses": _insert_courses,
    "update_course_par": _update_course_par,
    "insert_players": _insert_players,
    "upsert_events": _upsert_events,
    "resolve_names": lambda t: load.resolve_names(
        bound_name_map(t), t.players.where("hof_inducted")
    ),
    "insert_scores": _insert_scores,
    "refresh_to_par": lambda t: load.refresh_to_par(t).select("id", "strokes", "to_par"),
    "load_from_staging": _load_from_staging,
    "csv_sheet": _csv_sheet,
    "sheet_rejects": _sheet_rejects,
    "sheet_accepted": _sheet_accepted,
    "csv_name_map": _csv_name_map,
    "csv_backup": _csv_backup,
    "saved_tables": _saved_tables,
    "stored_changes": _stored_changes,
    "conflicting_changes": _conflicting_changes,
    "json_documents": _json_documents,
    "one_player_stats": lambda t: players.player_stats(t, player_id=ONE_PLAYER),
    "one_player_results": lambda t: players.player_results(t, player_id=ONE_PLAYER),
    "one_player_scores": lambda t: players.player_scores(t, player_id=ONE_PLAYER),
    "duplicate_player_keys": lambda t: quality.duplicate_keys(
        t.players.withColumn("last_name", F.col("hometown")), "players"
    ),
    "duplicate_raw_names": lambda t: quality.duplicate_keys(
        bound_name_map(t).withColumn("raw_full", F.col("first_name")), "name_map"
    ),
    "duplicate_course_keys": lambda t: quality.duplicate_keys(
        t.courses.withColumn("name", F.col("city")), "courses"
    ),
    "duplicate_event_keys": lambda t: quality.duplicate_keys(t.events, "events"),
    "duplicate_team_keys": lambda t: quality.duplicate_keys(t.scores, "scores"),
    "orphans": _orphans,
    "missing_values": lambda t: quality.missing_values(t.as_dict()),
    "text_lengths": lambda t: quality.text_lengths(t.as_dict()),
    "players_in_use": lambda t: quality.rows_in_use(t, "players", t.players),
    "courses_in_use": lambda t: quality.rows_in_use(t, "courses", t.courses),
    "delete_open_events": _delete_open_events,
    "update_scores": _update_scores,
    "update_players": _update_players,
    "update_courses": _update_courses,
    "insert_player_rows": _insert_player_rows,
    "insert_course_rows": _insert_course_rows,
    "insert_event_rows": _insert_event_rows,
    "insert_score_rows": _insert_score_rows,
    "delete_players": _delete_players,
    "delete_players_in_use": _delete_players_in_use,
    "delete_courses": _delete_courses,
    "delete_scores": _delete_scores,
    "not_found": _not_found,
}


def on_driver_tables(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(bound_tables(spark, sf_dir))
