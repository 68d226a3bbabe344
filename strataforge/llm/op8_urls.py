"""URL filter: subdomain rules, then logistic regression on hashed character n-grams.

`UrlModel` is trained by `train_url_model` on a small labelled URL table (a list of
(url, blocked) pairs, at most `max_rows`); `judge_urls` adds host, path, rule, score and
verdict to any table with a url column.

Defined cases: a null url, an empty one or one without `://` has an empty host and path and
no rule, and the model judges the empty strings by its intercept; repeated rows and ties stay
as they are; an empty table gives an empty table; columns of the input that bear the names of
the result's are left out of the result.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.llm._common import arrow_rows, ship, table

DIMS = 1 << 14
GRAMS = (3, 4, 5)
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: (host, path, verdict) of the contract's rules.
CONTRACT_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: what lies between the first `://` and the first `/`, `?` or `#`, and on to `?` or `#`."""
    m = _URL.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


class RuleTable:
    """Rules by host; a rule holds for its host and all subdomains if the path starts with its path."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, verdict, at = None, None, 0
        while True:
            for prefix, says in self.by_host.get(host[at:], ()):
                name = host[at:] + prefix
                if path.startswith(prefix) and (best is None or (len(name), name) > (len(best), best)):
                    best, verdict = name, says
            dot = host.find(".", at)
            if dot < 0:
                return best, verdict
            at = dot + 1


def gram_ids(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of host and of path, each with its own prefix, as distinct column numbers."""
    ids = set()
    for part, s in ((b"h", f"^{host}$"), (b"p", f"^{path}$")):
        raw = s.encode("utf-8", "replace")
        for n in GRAMS:
            for i in range(len(raw) - n + 1):
                ids.add(zlib.crc32(part + raw[i : i + n]) % DIMS)
    return np.fromiter(sorted(ids), dtype=np.int64, count=len(ids))


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    intercept: float
    threshold: float = 0.5

    def score(self, host: str, path: str) -> float:
        """Probability that the url is to be blocked; grams are weighted by 1 / sqrt(their number)."""
        ids = gram_ids(host, path)
        z = self.intercept + (self.weights[ids].sum() / np.sqrt(len(ids)) if len(ids) else 0.0)
        return float(1.0 / (1.0 + np.exp(-z)))


#: Words of hosts and paths in the labelled table, from general knowledge of such sites. Fixed values.
BAD_WORDS = (
    "casino poker betting slots jackpot gambling bets viagra cialis pharmacy pills meds xanax porn xxx sex adult cams escort dating singles nude replica fake knockoff loans payday credit cash lottery winner prize giveaway "
    "crypto doubler forex signals spam backlinks seo clickbait ads adserver banner popup tracker affiliate malware crack keygen warez torrent serials phishing verify-account miracle weightloss enlargement hot cheap discount free bonus win earn-money fast-cash"
).split()
GOOD_WORDS = (
    "library museum history science physics botany chemistry geology astronomy weather news tribune herald gazette journal review archive research institute college university school teachers kids garden kitchen recipes bakery cooking farm village town city council parliament "
    "embassy hospital clinic health medicine law economics statistics music opera theatre poetry books publisher cinema photo gallery architecture design engineering software developer docs wiki forum linux compiler hardware robotics railway sailing hiking mountain travel maps language "
    "history-club chess football tennis swimming birds zoo animals forest river lake harbour island carpenter potter weaver church charity museum-shop radio television magazine podcast"
).split()
TOPS = "com org net info biz io de fr uk es it eu us co example test dev club site online".split()
BAD_PATHS = "buy-now cheap/discount?aff=12 win/free-spins bonus/claim click?id=88&src=ad join/free xxx/gallery/7 hot/singles loan/apply casino/slots?ref=x order/no-prescription download/crack.exe verify/account promo/90-off".split()
GOOD_PATHS = "about articles/2019/autumn-leaves wiki/Volcano news/local/council-meeting papers/2020/042.pdf courses/algebra/lesson-3 archive/1998/ contact events/calendar?month=5 docs/install.html gallery/landscapes blog/2021/06/building-a-shed recipes/onion-soup search?q=rivers".split()


def labelled_urls(seed: int = 3, size: int = 1200) -> list[tuple[str, bool]]:
    """The small labelled table: hosts of one or two words, or of syllables without meaning (fine, as most unknown hosts are).

    Both kinds share top-level domains and prefixes. The host decides; paths of its kind are commoner, and many are mere numbers.
    """
    rnd = random.Random(seed)
    name = lambda: "".join(rnd.choice("bcdfgklmnprstvz") + rnd.choice("aeiou") + rnd.choice(["", "", "n", "r", "s"]) for _ in range(rnd.randint(2, 4)))
    out = []
    for k in range(size):
        bad = k % 3 == 0
        words = BAD_WORDS if bad else GOOD_WORDS
        if not bad and rnd.random() < 0.45:
            host = name()
        else:
            host = rnd.choice(words)
            if rnd.random() < 0.6:
                host += rnd.choice(["-", "", "-"]) + rnd.choice([rnd.choice(words), rnd.choice(words), name(), rnd.choice(GOOD_WORDS)])
        prefix = rnd.choice(["", "", "www.", "m.", "blog.", f"{name()}."])
        path = rnd.choice(["", f"{rnd.randint(1, 999)}", f"page/{rnd.randint(1, 99)}", rnd.choice(BAD_PATHS if bad else GOOD_PATHS), rnd.choice(BAD_PATHS if bad else GOOD_PATHS), rnd.choice(GOOD_PATHS)])
        out.append((f"http{rnd.choice(['', 's'])}://{prefix}{host}.{rnd.choice(TOPS)}/{path}", bad))
    return out


def train_url_model(rows: list[tuple[str, bool]], max_rows: int = 20_000, epochs: int = 400, l2: float = 1e-3, rate: float = 2.0) -> UrlModel:
    """Full-batch gradient descent on the labelled table; the driver holds at most max_rows rows of it."""
    if len(rows) > max_rows:
        raise ValueError(f"the labelled table has over {max_rows} rows")
    x = np.zeros((len(rows), DIMS), dtype=np.float32)
    for i, (url, _) in enumerate(rows):
        ids = gram_ids(*split_url(url))
        x[i, ids] = 1.0 / np.sqrt(max(1, len(ids)))
    used = np.flatnonzero(x.any(axis=0))
    xs, y = x[:, used].astype(np.float64), np.array([b for _, b in rows], dtype=np.float64)
    w, b = np.zeros(len(used)), 0.0
    for _ in range(epochs):
        gap = 1.0 / (1.0 + np.exp(-(xs @ w + b))) - y
        w -= rate * (xs.T @ gap / max(1, len(y)) * len(used) ** 0.5 / 10 + l2 * w)
        b -= 0.1 * rate * gap.mean() if len(y) else 0.0
    weights = np.zeros(DIMS)
    weights[used] = w
    return UrlModel(weights, float(b))


@lru_cache(maxsize=1)
def default_model() -> UrlModel:
    return train_url_model(labelled_urls())


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=CONTRACT_RULES, model: UrlModel | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score.

    A narrow map over id and url; rules and weights (DIMS doubles) ride along in the closure,
    both bounded. No shuffle.
    """
    model = model or default_model()
    rule_table = RuleTable(rules)
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()),
        T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("score", T.DoubleType()),
    ])

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths, found, verdicts, scores = [], [], [], [], []
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            rule, verdict = rule_table.find(host, path)
            score = model.score(host, path)
            hosts.append(host)
            paths.append(path)
            found.append(rule)
            verdicts.append(verdict or ("block" if score >= model.threshold else "allow"))
            scores.append(score)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(found, pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())],
            names=schema.names,
        )

    return df.select(F.col(id_col), F.col(url_col).cast("string")).mapInArrow(arrow_rows(judge), schema)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
