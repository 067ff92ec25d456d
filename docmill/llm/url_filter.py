"""URL filters: rules for hosts and paths, then host segmentation and naive Bayes.

A rule is a host and the start of a path. For a url that no rule fits, the names of its host are cut
into words, concatenated names by a unigram Viterbi search, and multinomial naive Bayes weighs the words
of host and path. The classes come from labelled hosts, the small list below or ones given. Frequencies
of other words come from a public vocabulary file, whose order is by frequency (the k-th word counts as
1/k of the first); words that are in neither class say nothing, but take their letters from words that
do: the "ads" in "roads" is none.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed, small_batches

#: Hosts, in words, of the two classes that the classifier learns from.
BLOCKED = """adult x|adult video|xxx tube|sex chat|hot sex|porn hub|free porn|nude cams|live cams|adult dating|hot singles|escort girls
casino win|online casino|casino bonus|free bets|sports bets|bet win|betting odds|poker room|slots jackpot|lottery win|free spins|gambling club
cheap pills|pills shop|buy pills|buy viagra|cialis online|cheap meds|online pharmacy|diet pills|weight loss|replica watches|cheap replica
spam farm|link farm|seo spam|click farm|click bait|buy likes|buy followers|free followers|fake reviews|traffic exchange
ads track|ad track|ads server|ad click|pop ads|track pixel|banner ads|ads network
free money|easy money|get rich|fast cash|quick loan|payday loans|crypto doubler|win prize|free prize|free iphone|claim prize|phish login
warez crack|crack keygen|free crack|torrent warez|malware download|pirate download""".replace("\n", "|")
ALLOWED = """daily news|world news|city news|news paper|news room|morning post|the times|evening star|weather report|sports news
city library|public library|book club|book shop|open library|history museum|art museum|music school|high school|state university|college science
science journal|health journal|medical center|city hospital|family doctor|health service|research lab|data science|open source|code blog
home garden|garden club|cook book|food recipes|kitchen recipes|travel guide|city guide|hotel guide|hiking club|photo blog|film review|game review
local shop|book store|music store|hardware store|house build|car repair|bike shop|green energy|water works|city council|town hall|law office
my blog|tech blog|mail service|web design|cloud host|project docs|user forum|help desk|support wiki|the free encyclopedia""".replace("\n", "|")
#: Names of a host or path that carry no topic.
NEUTRAL = frozenset("www m blog web mobile com net org info io co example en de fr es it html htm php index page http https".split())
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Log-odds for blocking from which a url is blocked, and what a class weighs before any word.
MARGIN, PRIOR = 0.0, math.log(0.25)
#: The longest word looked for, and what each letter of an unknown stretch costs.
LONGEST, PER_LETTER = 20, 2.5
_NAME = re.compile(r"[a-z]+")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    before, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


@lru_cache(maxsize=None)
def _split_rules(rules: tuple[tuple[str, str], ...]) -> dict[str, list[tuple[str, str, str]]]:
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        host, _, path = rule.partition("/")
        by_host.setdefault(host, []).append(("/" + path, rule, verdict))
    return by_host


def rule_for(host: str, path: str, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[str, str] | None:
    """The longest rule whose host is the url's or one above it, and with whose path the url's starts."""
    by_host, best, name = _split_rules(rules), None, host
    while name:
        for start, rule, verdict in by_host.get(name, ()):
            if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
        name = name.partition(".")[2]
    return best


def ranked_words(path: str) -> list[str]:
    """Words of letters of a public vocabulary file with word ends, most frequent first."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    whole = sorted((i, x[:-4]) for x, i in vocabulary.items() if x.endswith("</w>"))
    return [w for _, w in whole if w in ("a", "i") or len(w) > 1 and w.isascii() and w.isalpha()]


class Classifier:
    """Unigram word model and multinomial naive Bayes, fitted to two lists of hosts and a list of words by frequency."""

    def __init__(self, blocked: str = BLOCKED, allowed: str = ALLOWED, ranked: tuple[str, ...] = ()):
        self.counts = [Counter(re.split(r"[ |]", x)) for x in (allowed, blocked)]
        labelled = self.counts[0] + self.counts[1]
        words = {w: max(1.0, len(ranked) / (50.0 + k)) for k, w in enumerate(ranked)}
        for w in [*labelled, *NEUTRAL]:
            if len(w) > 1 or w == "x":
                words[w] = max(words.get(w, 0.0), len(ranked) / 2000.0) + max(1, labelled[w])
        total = sum(words.values())
        self.cost = {w: -math.log(n / total) for w, n in words.items()}
        self.unknown = math.log(total)
        vocabulary = len(labelled)
        sums = [sum(c.values()) for c in self.counts]
        self.odds = {
            w: math.log((self.counts[1][w] + 0.5) / (sums[1] + 0.5 * vocabulary)) - math.log((self.counts[0][w] + 0.5) / (sums[0] + 0.5 * vocabulary))
            for w in labelled
            if w not in NEUTRAL
        }
        self.memo: dict[str, tuple[str, ...]] = {}

    def segment(self, name: str) -> tuple[str, ...]:
        """Cheapest split of a name of letters into words; unknown stretches cost more with each letter and stay whole."""
        known = self.memo.get(name)
        if known is not None:
            return known
        n = len(name)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                c = best[i][0] + self.cost.get(name[i:j], self.unknown + PER_LETTER * (j - i))
                if c < best[j][0]:
                    best[j] = (c, i)
        out, j = [], n
        while j:
            i = best[j][1]
            out.append(name[i:j])
            j = i
        if len(self.memo) > 200_000:
            self.memo.clear()
        result = self.memo[name] = tuple(out[::-1])
        return result

    def words(self, host: str, path: str) -> list[str]:
        return [w for name in _NAME.findall(host) + _NAME.findall(path.lower()) for w in self.segment(name)]

    def score(self, words: list[str]) -> float:
        """Log-odds for blocking."""
        return PRIOR + sum(self.odds.get(w, 0.0) for w in words)


@lru_cache(maxsize=4)
def classifier(vocabulary: str | None = None, blocked: str = BLOCKED, allowed: str = ALLOWED) -> Classifier:
    return Classifier(blocked, allowed, tuple(ranked_words(vocabulary)) if vocabulary else ())


def judge(
    urls: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules: tuple[tuple[str, str], ...] = RULES, vocabulary: str | None = None, blocked: str = BLOCKED, allowed: str = ALLOWED
) -> DataFrame:
    """Columns ``keep``, host, path, rule, verdict, score, words and known_words of each row.

    rule is the one that fits (null if none does), verdict its own or else the classifier's: block if
    the score, log-odds over the words of host and path, is above the margin. known_words tells how many of
    the words are in a class. ``vocabulary`` is the path of a vocabulary file on every worker, ``blocked`` and
    ``allowed`` are hosts of the two classes, in words, parted by ``|``. Null urls and ones without ``://`` have an
    empty host and path and are allowed. Repeated rows give repeated results, other columns don't matter,
    a kept column named like a result's gets _given behind its name, an empty table gives no rows.
    """
    small_batches(urls.sparkSession)
    own = "host string, path string, rule string, verdict string, score double, words string, known_words int"
    source, names, schema = narrowed(urls, keep, own, F.col(f"`{url}`"))

    def run(batches):
        c = classifier(vocabulary, blocked, allowed)
        for batch in batches:
            rows = []
            for x in batch.column(len(names)).to_pylist():
                host, path = host_and_path(x)
                rule = rule_for(host, path, rules)
                words = c.words(host, path)
                score = c.score(words)
                verdict = rule[1] if rule else "block" if score > MARGIN else "allow"
                rows.append((host, path, rule and rule[0], verdict, score, " ".join(words), sum(w in c.odds for w in words)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(v, t) for v, t in zip(columns, kinds))], names=schema.names)

    return source.mapInArrow(run, schema)
