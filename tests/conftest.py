import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tastegrid.sources.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


HISTORIES = {
    11: {102: 4.5, 104: 4.0, 105: 2.0, 107: 3.5, 109: 5.0, 112: 3.0},
    12: {101: 2.5, 104: 4.5, 110: 4.0},
    13: dict(zip(range(101, 113), [3.0, 4.0, 2.5, 4.5, 3.5, 5.0, 1.5, 4.0, 3.0, 2.0, 4.5, 3.5])),
    14: {102: 1.0, 109: 2.5},
}
CATALOGUE = {
    101: "Western", 102: "Noir|Musical", 103: "Musical", 104: "Noir", 105: "Heist|Western", 106: "Noir|Heist",
    107: "Western|Musical", 108: "Heist", 109: "Noir|Western", 110: "Heist|Musical", 111: "Western", 112: "Noir",
}


@pytest.fixture(scope="session")
def cold(spark):
    """Four users with 6, 3, 12 and 2 ratings over twelve items."""
    rows = [(u, i, s) for u, mine in HISTORIES.items() for i, s in mine.items()]
    ratings = spark.createDataFrame(
        [(*r, n) for n, r in enumerate(rows)], "userId long, movieId long, rating double, timestamp long"
    )
    movies = spark.createDataFrame(
        [(i, f"Reel {i}", g) for i, g in CATALOGUE.items()], "movieId long, title string, genres string"
    )
    return ratings, movies


def random_world(seed: int, users: int, items: int, share: float, hot_user: int | None = None):
    """Plain Python ratings and movies; genre texts repeat so that classes have several items."""
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "e", "f"]
    movies = []
    for i in range(1, items + 1):
        picked = rng.sample(words, rng.randint(1, 3))
        movies.append((i, f"t{i}", None if i % 17 == 0 else "|".join(picked)))
    ratings = []
    clock = 0
    for u in range(1, users + 1):
        for i in range(1, items + 1):
            if u == hot_user or rng.random() < share * (u % 4) / 2:
                clock += 1
                ratings.append((u, i, rng.randint(1, 10) / 2, clock))
    return ratings, movies


@pytest.fixture(scope="session")
def world(spark):
    """A random catalogue and histories of very different length, with one user who rated everything."""
    ratings, movies = random_world(5, 40, 60, 0.12, hot_user=40)
    return (
        ratings,
        movies,
        spark.createDataFrame(ratings, "userId long, movieId long, rating double, timestamp long"),
        spark.createDataFrame(movies, "movieId long, title string, genres string"),
    )
