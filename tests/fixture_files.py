"""Source files of a small results feed. Players, events and results are made up; file names and columns are those that the load knows."""

from __future__ import annotations

from pathlib import Path

# The columns of a match file.
_SIDE = ("id", "seed", "entry", "name", "hand", "ht", "ioc", "age")
_STATS = ("ace", "df", "svpt", "1stIn", "1stWon", "2ndWon", "SvGms", "bpSaved", "bpFaced")
MATCH_COLUMNS = [
    "tourney_id",
    "tourney_name",
    "surface",
    "draw_size",
    "tourney_level",
    "tourney_date",
    "match_num",
    *[f"winner_{c}" for c in _SIDE],
    *[f"loser_{c}" for c in _SIDE],
    "score",
    "best_of",
    "round",
    "minutes",
    *[f"{side}_{c}" for side in "wl" for c in _STATS],
    "winner_rank",
    "winner_rank_points",
    "loser_rank",
    "loser_rank_points",
]

OSK, PELL, QUARN, RILL, STAV, TARN, UMBER = 11, 12, 13, 21, 22, 31, 41
#: The roster of the feed: its cohorts are those that the marts know. Vane never appears in a file.
ROSTER = [
    (OSK, "Osk", "Big 3", 1),
    (PELL, "Pell", "Big 3", 2),
    (QUARN, "Quarn", "Big 3", 3),
    (RILL, "Rill", "New generation", 4),
    (STAV, "Stav", "New generation", 5),
    (TARN, "Tarn", "Big 3 era challengers", 6),
    (32, "Vane", "Big 3 era challengers", 7),
]


def match(
    tourney, name, surface, level, date, num, winner, loser, score, best_of, round_code, minutes,
    winner_rank, loser_rank, **more,
):
    return {
        "tourney_id": tourney,
        "tourney_name": name,
        "surface": surface,
        "tourney_level": level,
        "tourney_date": date,
        "match_num": num,
        "winner_id": winner,
        "loser_id": loser,
        "score": score,
        "best_of": best_of,
        "round": round_code,
        "minutes": minutes,
        "winner_rank": winner_rank,
        "loser_rank": loser_rank,
        **more,
    }


# Osk wins a cup at 21 and Pell loses early at 17; nine years on Pell beats Quarn in a slam final; at the end Rill
# goes through Quarn and Osk to a slam, and Stav takes a title from Rill after Pell has not come to play.
MATCHES_1998 = [
    match("1998-11", "Harbour Cup", "Clay", "M", "19980504", 30, OSK, UMBER, "6-2 6-3", 3, "F", 75, 12, 33),
    match("1998-60", "Us Open", "Hard", "G", "19980831", 5, UMBER, PELL, "6-4 3-6 6-4 6-4", 5, "R32", 160, 33, 8),
]
MATCHES_2007 = [
    match("2007-61", "Summit Open", "Grass", "G", "20070702", 64, PELL, QUARN, "7-5 6-4 6-4", 5, "F", 141, 1, 10),
    match("2007-61", "Summit Open", "Grass", "G", "20070702", 63, QUARN, TARN, "6-0 6-1 6-2", 5, "SF", 68, 10, 25),
    match("2007-88", "Lantern Classic", "Carpet", "A", "20071015", 7, TARN, OSK, "1-0 RET", 3, "QF", 11, 25, 2),
]
MATCHES_2019 = [
    match("2019-61", "Summit Open", "Grass", "G", "20190701", 64, RILL, OSK, "6-4 6-4 7-6", 5, "F", 177, 5, 40),
    match("2019-61", "Summit Open", "Grass", "G", "20190701", 62, RILL, QUARN, "6-3 6-3 6-3", 5, "SF", 104, 5, 9),
    match("2019-90", "Cavern Masters", "Hard", "M", "20191028", 21, STAV, RILL, "6-7 6-4 6-2", 3, "F", 129, 11, 3),
    match("2019-90", "Cavern Masters", "Hard", "M", "20191028", 20, STAV, PELL, "W/O", 3, "SF", None, 11, 55),
]
PLAYER_COLUMNS = "player_id,name_first,name_last,hand,dob,ioc,height,wikidata_id".split(",")
PLAYERS = [
    (OSK, "Odo", "Osk", "R", "19770310", "NOR", 178, None),
    (PELL, "Pim", "Pell", "L", "19800915", "BEL", 193, None),
    (QUARN, "Quin", "Quarn", "R", "19821101", "IRL", 181, None),
    (RILL, "Rolf", "Rill", "R", "19961220", "AUT", 188, None),
    (STAV, "Sten", "Stav", "L", "19980404", "DEN", 195, None),
    (TARN, "Tor", "Tarn", "U", "19840707", "FIN", None, None),
    (UMBER, "Ulf", "Umber", "R", "19751231", "SWE", 174, None),
]
RANKING_COLUMNS = ["ranking_date", "rank", "player", "points"]
RANKINGS = {
    "00s": [("20070709", 1, PELL, 5200), ("20070716", 1, PELL, 5215), ("20070709", 2, OSK, 5000)],
    "10s": [("20190708", 1, RILL, 6400), ("20191104", 1, STAV, 6555)],
    "current": [("20191104", 2, RILL, 6510)],
}


def _field(value) -> str:
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text


def write_csv(path: Path, columns, rows) -> Path:
    lines = [",".join(columns)]
    for row in rows:
        values = [row.get(c) for c in columns] if isinstance(row, dict) else row
        lines.append(",".join(_field(v) for v in values))
    path.write_text("\n".join(lines) + "\n")
    return path


def write_matches(folder: Path, season: int, rows, columns=MATCH_COLUMNS) -> Path:
    return write_csv(folder / f"atp_matches_{season}.csv", columns, rows)


def write_feed(folder: Path) -> Path:
    folder.mkdir(parents=True, exist_ok=True)
    for season, rows in ((1998, MATCHES_1998), (2007, MATCHES_2007), (2019, MATCHES_2019)):
        write_matches(folder, season, rows)
    write_csv(folder / "atp_players.csv", PLAYER_COLUMNS, PLAYERS)
    for name, rows in RANKINGS.items():
        write_csv(folder / f"atp_rankings_{name}.csv", RANKING_COLUMNS, rows)
    return folder
