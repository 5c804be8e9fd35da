from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from conftest import day, frame, rows
from pyspark.sql import functions as F

from clubhouse.plans import courses, events, homepage, leaderboards, players, wins
from clubhouse.tables import Tables, empty_tables

D = Decimal


def test_career_wins(either):
    found = {r.player_id: r for r in wins.career_wins(either).collect()}
    # Two tied teams share the win; the player named twice gets two halves.
    assert found[1].career_wins == D("1.00") and found[1].major_wins == D("1.00")
    assert found[2].career_wins == D("0.50") and found[2].major_wins == D("0.50")
    # A disqualified or unfinalized first place is no win, but the former is an event.
    assert found[1].events_played == 2 and found[2].events_played == 2
    assert found[3].career_wins == D("0.00") and found[3].events_played == 2
    assert tuple(found[4])[1:] == ("Di Elm", D("0.00"), 0, D("0.00"))


def test_top_players_order_and_rank(either):
    assert rows(wins.top_players(either, 3), "player_id") == [(1,), (2,), (3,)]
    assert sorted(rows(wins.ranked_top_players(either, 2))) == [
        (1, 1, "Ada Birch", "1.00", "1.00", 2), (2, 2, "Ben Cole", "0.50", "0.50", 2),
    ]


def test_wins_by_event_name(either):
    found = {(r.player_id, r.event_name): r for r in wins.wins_by_event_name(either).collect()}
    # "Open" is a finalized and an unfinalized event.
    assert found[1, "Open"].career_wins == D("1.00") and found[1, "Open"].events_played == 1
    assert found[1, "Cup"].career_wins == D("0.00") and found[1, "Cup"].events_played == 1
    assert found[4, None].events_played == 0
    assert len(found) == 7
    assert rows(wins.top_by_event_name(either, 1), "player_id", "event_name") == [(1, "Open")]


def test_thirds_make_a_whole(spark, league):
    scores = frame(spark, "scores", [
        {"id": i, "event_id": 1, "player1_id": p, "placement": 1, "disqualified": False}
        for i, p in enumerate([1, 1, 1], 1)
    ])
    found = wins.career_wins(league.with_tables(scores=scores)).where("player_id = 1")
    assert rows(found, "career_wins") == [(D("1.00"),)]


def test_winner_shares_add_up(league):
    """Every finalized event with a winner gives away members / winning teams."""
    total = wins.career_wins(league).agg(F.sum("career_wins")).first()[0]
    assert total == D("1.50")  # (2 slots + 1 slot) / 2 teams


def test_player_stats(either):
    found = {r.player_id: r for r in players.player_stats(either).collect()}
    # The row naming player 1 twice counts once; unfinalized and disqualified rows count.
    assert found[1].events_played == 3 and found[1].events_won == 3 and found[1].podiums == 3
    assert found[1].avg_strokes == D("69.00")  # 70, 66, 71
    assert found[1].avg_to_par == D("-2.33")  # -2, -4, -1
    assert found[1].first_event_date == day(1) and found[1].last_event_date == day(3)
    # The stored to-par of row 13 wins over strokes - par.
    assert found[2].avg_to_par == D("2.33") and found[2].best_finish == 1
    assert found[3].events_played == 2 and found[3].podiums == 2
    assert tuple(found[4])[1:] == (0, 0, 0, None, None, None, None, None, 0)


def test_stats_count_at_least_the_career_events(league):
    both = players.player_stats(league).alias("s").join(
        wins.career_wins(league).alias("w"), "player_id"
    )
    assert both.where("s.events_played < w.events_played").isEmpty()


def test_player_results(either):
    found = rows(players.player_results(either), "player_id", "score_id", "to_par", "player2_name")
    assert found == [
        (1, 31, -1, ""), (1, 21, -4, "Cy Drake"), (1, 11, -2, "Ada Birch"),
        (2, 22, 0, ""), (2, 12, -2, ""), (2, 13, 9, "Ben Cole"),
        (3, 21, -4, "Cy Drake"), (3, 23, None, ""), (3, 13, 9, "Ben Cole"),
    ]


def test_player_scores(either):
    found = rows(players.player_scores(either), "player_id", "id", "to_par", "player2_name")
    assert found[:3] == [(1, 31, None, None), (1, 21, None, "Cy Drake"), (1, 11, None, "Ada Birch")]
    assert len(found) == 9


def test_player_list(either):
    assert rows(players.player_list(either), "id", "full_name")[0] == (1, "Ada Birch")
    assert rows(players.player_by_id(either, 3), "full_name") == [("Cy Drake",)]
    assert players.player_by_id(either, 99).isEmpty()


def test_events_around_a_date(either):
    assert rows(events.latest_event(either, day(3)), "id", "course_par") == [(3, 72)]
    assert rows(events.next_event(either, day(3)), "id", "course_par") == [(4, 70)]
    # Upcoming includes the day itself, the next event does not.
    assert rows(events.upcoming_events(either, day(3)), "id") == [(3,), (4,)]
    assert events.latest_event(either, dt.date(2024, 1, 1)).isEmpty()
    assert rows(events.latest_finalized(either, 5), "id", "course") == [
        (2, "Short Meadow"), (1, "Long Meadow"),
    ]


def test_event_lists(either):
    assert rows(events.event_list(either), "id", "course_name")[0] == (4, "Short Meadow")
    located = rows(events.event_list_with_location(either), "id", "course_location")
    assert located == [(4, None), (3, "Oak Hill, MN"), (2, None), (1, "Oak Hill, MN")]
    assert rows(events.event_by_id(either, 2), "name", "course_par") == [("Cup", 70)]
    wanted = either.spark.createDataFrame([(2,), (2,), (9,)], "id bigint")
    found = events.with_ids(events.event_list(either, ordered=False), wanted)
    assert sorted(rows(found, "id", "found")) == [(2, True), (9, False)]


def test_courses(either):
    assert rows(courses.course_list(either), "name") == [("Long Meadow",), ("Short Meadow",)]
    assert rows(courses.course_by_id(either, 2), "par") == [(70,)]


def test_event_scores(either):
    board = leaderboards.event_scores(either)
    assert rows(board, "id") == [(11,), (12,), (13,), (21,), (22,), (23,), (31,)]
    one = rows(leaderboards.event_scores(either, 2), "id", "to_par", "player1_name")
    assert one == [(21, -4, "Ada Birch"), (22, 0, "Ben Cole"), (23, None, "Cy Drake")]


def test_score_list(either):
    listed = rows(leaderboards.score_list(either), "id", "player2_name")
    assert listed[0] == (31, None)
    assert [r[0] for r in listed] == [31, 21, 22, 23, 11, 12, 13]


def test_latest_event_top_includes_disqualified(either):
    top = rows(leaderboards.latest_event_top(either, day(2), 2), "id", "to_par", "player2_name")
    assert top == [(21, -4, "Cy Drake"), (22, 0, "")]


def test_podiums(either):
    flat = leaderboards.latest_podiums(either)
    assert rows(flat, "event_id", "id", "player_ids", "team_name") == [
        (2, 22, [2], "B. Cole"),
        (1, 11, [1, 1], "A. Birch / A. Birch"),
        (1, 12, [2], "B. Cole"),
        (1, 13, [3, 2], "C. Drake / B. Cole"),
    ]
    documents = leaderboards.podium_documents(either, 10).orderBy("id").collect()
    assert [(d.id, [p.teamName for p in d.podium]) for d in documents] == [
        (1, ["A. Birch / A. Birch", "B. Cole", "C. Drake / B. Cole"]), (2, ["B. Cole"]),
    ]
    hydrated = leaderboards.latest_podiums_hydrated(either.with_tables(
        players=either.players.where("id <> 3")
    ))
    assert ("Player #3 / B. Cole",) in rows(hydrated, "team_name")


def test_snippets(either):
    assert rows(leaderboards.leaderboard_snippet(either), "event_id", "id", "course") == [
        (2, 22, "Short Meadow")
    ]
    assert rows(leaderboards.leaderboard_snippet_outer(either), "id") == [(22,)]
    # An event without scores: the variant keeps it, the other does not.
    bare = either.with_tables(scores=either.scores.where("event_id <> 2"))
    assert leaderboards.leaderboard_snippet(bare).isEmpty()
    assert rows(
        leaderboards.leaderboard_snippet_outer(bare), "event_id", "id", "player_ids", "team_name"
    ) == [(2, None, [], "")]
    # An event with disqualified scores only: both give nothing.
    out = either.with_tables(scores=either.scores.where("disqualified"))
    assert leaderboards.leaderboard_snippet_outer(out).isEmpty()


def test_event_with_teams(either):
    found = {r.id: r for r in leaderboards.event_with_teams(either, 10).collect()}
    assert len(found) == 4 and found[4].teams == []
    assert [(t.id, t.player1, t.player2) for t in found[1].teams] == [
        (11, "Ada Birch", "Ada Birch"), (12, "Ben Cole", None), (13, "Cy Drake", "Ben Cole"),
    ]
    assert leaderboards.event_with_teams(either, 10, event_id=2).count() == 1


@pytest.mark.parametrize("page_size", [1, 3, 1_000_000])
def test_pages_joined_in_order_give_the_same_list(either, page_size):
    pages = leaderboards.event_with_teams(either, page_size, 1).orderBy("page").collect()
    assert [p.page for p in pages] == list(range(len(pages)))
    assert [t.id for p in pages for t in p.teams] == [11, 12, 13]
    flat = leaderboards.event_team_rows(either, 1).orderBy("position")
    assert rows(flat, "position", "id") == [(1, 11), (2, 12), (3, 13)]

    podium = leaderboards.podium_documents(either, page_size).where("id = 1").orderBy("page")
    places = [p.placement for page in podium.collect() for p in page.podium]
    assert places == [1, 1, 3]


def test_league_totals(either):
    assert rows(homepage.league_totals(either)) == [(4, 4, 1)]


def test_home_summary(either):
    one = homepage.home_summary(either, day(2)).first()
    assert tuple(one.totals) == (4, 4, 1)
    assert one.latest_event.id == 2 and one.latest_event.course_name == "Short Meadow"
    assert [r.id for r in one.latest_event.top_results] == [21, 22, 23]
    assert one.next_event.id == 3


def test_homepage(either):
    (page,) = homepage.homepage(either, day(3), 10).collect()
    assert [e.id for e in page.upcomingEvents] == [3, 4]
    assert [e.id for e in page.latestEvents] == [2, 1]
    assert page.leaderboardSnippet.event.name == "Cup"
    assert [r.teamName for r in page.leaderboardSnippet.rows] == ["B. Cole"]
    assert [p.player_id for p in page.topPlayers] == [1, 2, 3, 4]


def test_a_long_podium_continues_on_further_pages(league):
    pages = homepage.homepage(league, day(3), 1).orderBy("page").collect()
    assert pages[0].page == 0 and pages[0].topPlayers and len(pages) > 1
    assert {p.placement for e in pages[0].latestEvents for p in e.podium} == {1, 2}
    assert all(p.topPlayers is None for p in pages[1:])
    entries = [p for page in pages for e in page.latestEvents for p in e.podium]
    assert len(entries) == 4


@pytest.mark.parametrize("broadcast_rows", [0, 100])
def test_reports_on_empty_tables(spark, broadcast_rows):
    nothing = Tables(**empty_tables(spark).as_dict(), broadcast_rows=broadcast_rows)
    one = homepage.home_summary(nothing, day(1)).first()
    assert tuple(one.totals) == (0, 0, 0) and one.latest_event is None and one.next_event is None
    (page,) = homepage.homepage(nothing, day(1), 10).collect()
    assert page.latestEvents == [] and page.leaderboardSnippet is None
    assert page.upcomingEvents == [] and page.topPlayers == []
    assert wins.career_wins(nothing).isEmpty() and players.player_stats(nothing).isEmpty()


def test_lists_by_collation(spark, league):
    people = [{"id": i, "first_name": "A", "last_name": n, "hof_inducted": False}
              for i, n in enumerate(["zeta", "Ärger", "Zoll", "arm", "Öl", None, "Oase"])]
    grounds = [{"id": i, "name": n, "par": 70} for i, n in enumerate(["b", "Ä", "a", "B", "Z"])]
    t = league.with_tables(players=frame(spark, "players", people), courses=frame(spark, "courses", grounds))
    by_bytes = [r[0] for r in rows(players.player_list(t), "last_name")]
    assert by_bytes == ["Oase", "Zoll", "arm", "zeta", "Ärger", "Öl", None]
    for collation in ("UNICODE", "de"):
        listed = [r[0] for r in rows(players.player_list(t, collation=collation), "last_name")]
        assert listed == ["Ärger", "arm", "Oase", "Öl", "zeta", "Zoll", None]
        assert [r[0] for r in rows(courses.course_list(t, collation=collation), "name")] == ["a", "Ä", "b", "B", "Z"]
    assert [r[0] for r in rows(courses.course_list(t), "name")] == ["B", "Z", "a", "b", "Ä"]
    best = wins.top_players(t.with_tables(scores=league.scores.limit(0)), 3, collation="de")
    assert [r[0] for r in rows(best, "name")] == ["A", "A Ärger", "A arm"]
