"""SQL twins of the queries, written independently of the Spark plans (brute force where it is simpler)."""

from __future__ import annotations

PRIME = 2147483647
_X = f"((userId % {PRIME} * 1000003 + movieId % {PRIME} * 998244353 + {42 * 7919}) % {PRIME})"
_SQUARE = f"({_X} * {_X} % {PRIME})"
PAIR_HASH = f"({_SQUARE} * {_SQUARE} % {PRIME} * {_X} % {PRIME})"

VIEWS = {
    "ratings": """SELECT o_custkey AS "userId", l_partkey AS "movieId",
        CAST(ceil(l_quantity / 5) AS DOUBLE) * 0.5 AS rating,
        CAST(epoch(l_shipdate) AS BIGINT) AS "timestamp"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "movies": """SELECT p_partkey AS "movieId", p_name || ' #' || p_partkey AS title,
        p_type || '|' || replace(p_name, ' ', '|') AS genres FROM part""",
    "users": 'SELECT c_custkey AS "userId" FROM customer',
    "baskets": """SELECT l_orderkey AS "userId", l_partkey AS "movieId",
        CAST(ceil(l_quantity / 5) AS DOUBLE) * 0.5 AS rating,
        CAST(epoch(l_shipdate) AS BIGINT) AS "timestamp" FROM lineitem""",
    "basket_users": 'SELECT o_orderkey AS "userId" FROM orders',
    "train": f"""SELECT * FROM ratings
        WHERE {PAIR_HASH} % 1000 >= 200""",
    "test": f"""SELECT * FROM ratings
        WHERE {PAIR_HASH} % 1000 < 200""",
    "per_user": "SELECT userId, count(*) AS num_ratings FROM ratings GROUP BY userId",
    "per_item": "SELECT movieId, count(*) AS num_ratings, avg(rating) AS avg_rating FROM ratings GROUP BY movieId",
    "bridge": "SELECT movieId, unnest(string_split(genres, '|')) AS genre FROM movies WHERE genres IS NOT NULL",
    "submissions": """SELECT event_id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp", user_id AS "userId",
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS "movieId",
        CASE WHEN event_type = 'error' THEN value
             ELSE least(5.0, CAST(ceil(value / 10) AS DOUBLE) * 0.5) END AS rating FROM events""",
    "valid": """SELECT * FROM submissions WHERE rating BETWEEN 0.5 AND 5.0
        AND rating * 2 = floor(rating * 2) AND movieId >= 0""",
}


def popularity(source: str, prefix: str = "") -> dict[str, str]:
    """Views of the quantile popularity table over a ratings view; the last one is ``<prefix>pop``."""
    return {
        f"{prefix}stats": f"""SELECT movieId, count(*) AS num_ratings, avg(rating) AS avg_rating
            FROM {source} GROUP BY movieId""",
        f"{prefix}consts": f"""SELECT (SELECT quantile_cont(num_ratings, 0.25) FROM {prefix}stats) AS m,
            (SELECT avg(rating) FROM {source}) AS c""",
        f"{prefix}pop": f"""SELECT s.movieId, title, genres, num_ratings, avg_rating,
            (num_ratings / (num_ratings + m)) * avg_rating + (m / (num_ratings + m)) * c AS popularity_score
            FROM {prefix}stats s CROSS JOIN {prefix}consts LEFT JOIN movies ON movies.movieId = s.movieId""",
    }


def latest(source: str) -> str:
    """The last rating per pair, the higher one at equal times."""
    return f"""SELECT userId, movieId, max_by(rating, "timestamp" * 100 + rating) AS rating
        FROM {source} GROUP BY userId, movieId"""


def hybrid_lists(
    source: str, users: str, top: int | None, n: int = 10, below: int | None = None
) -> dict[str, str]:
    """Brute-force lists for every user: each user is scored against each rated item. Last view: ``recs``."""
    cut = "" if top is None else f"WHERE place <= {top}"
    limit = "" if below is None else f"WHERE num_ratings < {below}"
    return {
        **popularity(source),
        "latest": latest(source),
        "sized": f"""SELECT * FROM (SELECT u.userId, coalesce(c.n, 0) AS num_ratings FROM {users} u
            LEFT JOIN (SELECT userId, count(*) AS n FROM {source} GROUP BY userId) c ON c.userId = u.userId) {limit}""",
        "liked": """SELECT r.userId, b.genre, count(*) AS n FROM latest r
            JOIN bridge b ON b.movieId = r.movieId WHERE r.rating >= 3.5 GROUP BY r.userId, b.genre""",
        "placed": """SELECT *, row_number() OVER (PARTITION BY userId ORDER BY n DESC, genre) AS place
            FROM liked""",
        "prefs": f"SELECT userId, list(genre) AS pref FROM placed {cut} GROUP BY userId",
        "scored": """SELECT s.userId, p.movieId,
            CASE WHEN f.pref IS NULL THEN p.popularity_score
                 ELSE 0.6 * p.popularity_score / 5.0
                    + 0.4 * (len(list_intersect(f.pref, string_split(p.genres, '|'))) / len(f.pref))
            END AS score
            FROM sized s LEFT JOIN prefs f ON f.userId = s.userId CROSS JOIN pop p
            WHERE f.pref IS NULL OR p.genres IS NOT NULL""",
        "ranked": f"""SELECT * FROM (SELECT x.*, CAST(row_number() OVER (PARTITION BY x.userId
            ORDER BY x.score DESC, x.movieId) AS INTEGER) AS rank FROM scored x
            WHERE NOT EXISTS (SELECT 1 FROM latest r WHERE r.userId = x.userId AND r.movieId = x.movieId))
            WHERE rank <= {n}""",
        "recs": """SELECT k.userId, k.rank, k.movieId, p.title, p.genres, k.score, s.num_ratings
            FROM ranked k JOIN pop p ON p.movieId = k.movieId JOIN sized s ON s.userId = k.userId""",
    }


def popular_lists(source: str, n: int = 10) -> dict[str, str]:
    """Brute-force popular items per user minus the user's own. Last view: ``recs``."""
    return {
        **popularity(source),
        "recs": f"""SELECT * FROM (SELECT u.userId, p.movieId, p.popularity_score AS score,
            CAST(row_number() OVER (PARTITION BY u.userId ORDER BY p.popularity_score DESC, p.movieId) AS INTEGER) AS rank
            FROM users u CROSS JOIN pop p
            WHERE NOT EXISTS (SELECT 1 FROM {source} r WHERE r.userId = u.userId AND r.movieId = p.movieId))
            WHERE rank <= {n}""",
    }


# Fixed factors of a model that SQL can score: eighths of numbers below 65, so that sums are exact.
FIXED_WIDTH, FIXED_MEAN = 8, 3.25


def fixed_vector(key: str) -> str:
    numbers = ", ".join(f"(({key} * {2 * k + 3} + {7 * k}) % 65 - 32) / 32.0" for k in range(FIXED_WIDTH))
    return f"[{numbers}]::DOUBLE[]"


_NO_VECTOR = f"[{', '.join(['0.0'] * FIXED_WIDTH)}]::DOUBLE[]"


def fixed_bias(key: str) -> str:
    return f"(({key} * 5) % 33 - 16) / 64.0"


def fixed_factors(users: str) -> dict[str, str]:
    """Views of the fixed model: an eleventh of the users and a thirteenth of the items are unknown to it."""
    return {
        "fu": f"""SELECT userId, CASE WHEN userId % 11 <> 0 THEN {fixed_vector("userId")} ELSE {_NO_VECTOR} END AS p,
            CASE WHEN userId % 11 <> 0 THEN {fixed_bias("userId")} ELSE 0 END AS bu FROM {users}""",
        "fi": f"""SELECT movieId, title, genres, CASE WHEN movieId % 13 <> 0 THEN {fixed_vector("movieId")} ELSE {_NO_VECTOR} END AS q,
            CASE WHEN movieId % 13 <> 0 THEN {fixed_bias("movieId")} ELSE 0 END AS bi FROM movies""",
    }


FIXED_SCORE = "bi + list_inner_product(p, q)"


def fixed_lists(users: str, rated: str, n: int = 10) -> dict[str, str]:
    """Brute-force lists of the fixed model for ``users`` without the pairs in ``rated``. Last view: ``fixed_recs``."""
    return {
        **fixed_factors(users),
        "fixed_recs": f"""SELECT userId, rank, movieId, title, genres,
            round(greatest(0.5, least(5.0, {FIXED_MEAN} + bu + score)), 2) AS predicted_rating
            FROM (SELECT *, CAST(row_number() OVER (PARTITION BY userId ORDER BY score DESC, movieId) AS INTEGER) AS rank
                FROM (SELECT u.userId, u.bu, i.movieId, i.title, i.genres, {FIXED_SCORE} AS score FROM fu u CROSS JOIN fi i)
                WHERE (userId, movieId) NOT IN (SELECT (userId, movieId) FROM {rated})) WHERE rank <= {n}""",
    }


def offsets(train: str, prefix: str = "", item_damping: float = 10.0, user_damping: float = 5.0) -> dict[str, str]:
    """Views of the damped offsets over a ratings view: ``m``, ``ib`` and ``ub`` behind the prefix."""
    return {
        f"{prefix}m": f"SELECT avg(rating) AS m FROM {train}",
        f"{prefix}ib": f"""SELECT movieId, sum(rating - m) / (count(*) + {item_damping}) AS bi
            FROM {train} CROSS JOIN {prefix}m GROUP BY movieId""",
        f"{prefix}ub": f"""SELECT userId, sum(rating - m - bi) / (count(*) + {user_damping}) AS bu
            FROM {train} JOIN {prefix}ib USING (movieId) CROSS JOIN {prefix}m GROUP BY userId""",
    }


_TWO64 = "18446744073709551616::UHUGEINT"


def _mixed(x: str) -> str:
    """Two xor-shift-multiply rounds on 64 bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = f"list_transform([{x}], lambda z: (xor(z, z >> {shift}) * {factor}::UHUGEINT) % {_TWO64})[1]"
    return f"list_transform([{x}], lambda z: xor(z, z >> 31))[1]"


def first_sign(key: str, seed: int = 42) -> str:
    """Sign of the first number that is drawn for an id: its cosine has the sign of the quadrant."""
    golden, start = 0x9E3779B97F4A7C15, (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64
    x = _mixed(f"(({key})::UHUGEINT + {start}::UHUGEINT) % {_TWO64}")
    for _ in range(2):
        x = _mixed(f"({x} + {golden}::UHUGEINT) % {_TWO64}")
    return f"CASE WHEN {x} % 16777216 BETWEEN 4194304 AND 12582912 THEN -1.0 ELSE 1.0 END"


def rank_one(train: str, reg: float, epochs: int, prefix: str = "") -> dict[str, str]:
    """Views of alternating least squares with one factor on what the offsets leave: ``pu`` and ``qi`` behind the prefix."""
    views = {
        **offsets(train, prefix),
        f"{prefix}rest": f"""SELECT userId, movieId, avg(rating) - any_value(m) - any_value(bi) - any_value(bu) AS r
            FROM {train} JOIN {prefix}ib USING (movieId) JOIN {prefix}ub USING (userId) CROSS JOIN {prefix}m GROUP BY userId, movieId""",
        f"{prefix}p0": f"SELECT userId, {first_sign('userId')}::FLOAT AS p FROM (SELECT DISTINCT userId FROM {train})",
    }
    for e in range(1, epochs + 1):
        views[f"{prefix}q{e}"] = f"""SELECT movieId, (sum(p::DOUBLE * r) / (sum(p::DOUBLE * p) + {reg} * count(*)))::FLOAT AS q
            FROM {prefix}rest JOIN {prefix}p{e - 1} USING (userId) GROUP BY movieId"""
        views[f"{prefix}p{e}"] = f"""SELECT userId, (sum(q::DOUBLE * r) / (sum(q::DOUBLE * q) + {reg} * count(*)))::FLOAT AS p
            FROM {prefix}rest JOIN {prefix}q{e} USING (movieId) GROUP BY userId"""
    views[f"{prefix}pu"] = f"SELECT userId, p::DOUBLE AS p FROM {prefix}p{epochs}"
    views[f"{prefix}qi"] = f"SELECT movieId, q::DOUBLE AS q FROM {prefix}q{epochs}"
    return views


def rank_one_scores(test: str, prefix: str = "") -> str:
    """``test`` with the estimate of the one-factor model as ``e``."""
    return f"""SELECT t.*, greatest(0.5, least(5.0, m + coalesce(bi, 0) + coalesce(bu, 0) + coalesce(p * q, 0))) AS e
        FROM {test} t CROSS JOIN {prefix}m LEFT JOIN {prefix}ib i ON i.movieId = t.movieId LEFT JOIN {prefix}ub u ON u.userId = t.userId
        LEFT JOIN {prefix}pu a ON a.userId = t.userId LEFT JOIN {prefix}qi b ON b.movieId = t.movieId"""


def sql(body: str, *names: str, **views: str) -> str:
    """``body`` under a WITH clause of the named standard views and the given extra views."""
    needed: list[str] = []
    uses = {
        "train": ["ratings"],
        "test": ["ratings"],
        "per_user": ["ratings"],
        "per_item": ["ratings"],
        "bridge": ["movies"],
        "valid": ["submissions"],
    }
    for name in names:
        for view in [*uses.get(name, []), name]:
            if view not in needed:
                needed.append(view)
    parts = [f"{name} AS ({VIEWS[name]})" for name in needed]
    parts += [f"{name} AS ({text})" for name, text in views.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
