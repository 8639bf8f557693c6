"""URL filter: logistic regression on hashed character n-grams of host and path.

Features are the n-grams of 3 to 5 bytes of the lower-case host (without ``www.``) and of the
path with its query, each with a mark at both ends, hashed into 2 ** ``BITS`` places apart for host
and path; each distinct one counts 1 / sqrt(number of them in the host, or in the path). The model is trained on the driver by
gradient descent with momentum and L2 from a small labelled table (``labelled_urls``, or any frame of url, bad)
and travels with the tasks: 256 KB whatever the data. Batches of URLs are scored by whole columns.

The labelled table knows words of unwanted hosts, not hosts: what it says about other words comes from
the n-grams that they share with known ones (inflections, compounds). A word that shares none gets
about one half and is kept.

Null URLs have a null probability and are kept; empty ones are scored as such, very long ones whole.
Each row is judged by itself, so repeated rows and ids do no harm; an empty table gives an empty
result. Only page_id and url are read, whatever other columns there are. With no labelled rows every
probability is one half. ``bad`` means a probability above ``THRESHOLD``.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrowtext import chunks
from sparkloom.llm.common import small_batches

BITS, SIZES, STEPS, RATE, DECAY = 16, (3, 4, 5), 300, 10.0, 1e-5
#: The probability above which a URL is bad.
THRESHOLD = 0.5
#: URLs whose n-grams are held at once.
ROWS = 4096
URL = r"(?s)^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?P<host>[^/?#]*)(?P<path>.*)$"

#: Words of unwanted hosts by kind. They are inflections and compounds; ordinary words that look alike are in ORDINARY.
UNWANTED = {
    "gambling": "casinos kasino gambling gambler roulette blackjack betting bettor sportsbet betslip bookmakers wagering pokerroom jackpots slotmachine freespins freeroll winnings winner bingo lottery baccarat bet betshop sportsbetting freemoney",
    "pharmacy": "pillen pillstore dietpill pharmacy viagras cialis cheapmeds cheapest tramadol steroids painkiller discountmeds weightloss",
    "advertising": "adserver adsnetwork adspace adclick popads popunder clickads adserving tracker tracking trackpixel webtrackers retargeting clickbait clicktrack doubleclick bannerads",
    "spam": "spammer spamming spambot spammail linkfarms farming linkbuilding backlinks bulkmail seoboost doorway contentfarms spams spamdomain",
    "sex": "adults adulte adulttube xxxvideo xxxtube porno camgirls escorts hookups webcamsex erotik nudes sexchat",
    "fraud": "phishing malware keygen warez cracked payday fastloans cryptodouble giveaway ransom fakelogin",
}
ORDINARY = """garden kitchen history school museum science weather library travel recipes music sports news health physics biology poetry mountain river theatre village
forum docs wiki research journal archive planet ocean forest bridge market chess climbing camera window twins darwin winter window freedom freeway frieze better alphabet beta debate tibet adventure
advice address shadow leads heads beads radio tracks contract attraction racetrack farmhouse farmers pharma-history pillow pillar pilgrim caterpillar span spanish space sparrow espana casa casita cascade
adulation education example maxwell luxury texas linux proxy oxford exhibit school translation station nation motion thermal weather mother father brother theory method athens north other therapy
reading cooking running learning painting gardening hiking building swimming morning evening wedding cycling teaching knitting spring thing everything baker teacher writer player computer letter number butter
theory three thread other another either whether gather together rather lather thesis theme there where here hero herb inner outer order under thunder render tender center
schreiben lernen garten kuche wetter schule entre campo ciudad libro noticias salud maison jardin livre actualite sante cuisine ecole voyage""".split()
ENDINGS = ("com", "net", "org", "info", "de", "fr", "es", "co.uk", "io", "biz", "eu", "xyz")
PREFIXES = ("", "www.", "shop.", "m.", "my.", "old.")
PATHS = ("/", "/index.html", "/2023/11/a-longer-title-of-a-story", "/item.php?id=1834", "/category/view", "/p/77", "/search?q=some+words", "/about-us", "/#start", "/static/page3.htm")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: hosts of unwanted and of ordinary words under the same endings and paths."""
    kinds = [words.split() for words in UNWANTED.values()]
    hosts = [(w, 1) for words in kinds for w in words] + [(f"{a}-{b}", 1) for words in kinds for a, b in itertools.pairwise(words)]
    hosts += [(f"{w}{'-' * (i % 2)}{ORDINARY[(7 * i) % len(ORDINARY)]}", 1) for i, w in enumerate(w for words in kinds for w in words)]
    hosts += [(w, 0) for w in ORDINARY] + [(f"{a}-{b}", 0) for a, b in itertools.pairwise(ORDINARY)] + [(f"{a}{b}", 0) for a, b in zip(ORDINARY, ORDINARY[11:])]
    return [
        (f"{'https' if (i + k) % 2 else 'http'}://{PREFIXES[(i + k) % len(PREFIXES)]}{host}.{ENDINGS[(3 * i + 5 * k) % len(ENDINGS)]}{PATHS[(7 * i + 3 * k) % len(PATHS)]}", bad)
        for i, (host, bad) in enumerate(hosts) for k in range(2)
    ]


def features(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of the distinct n-grams of the URLs, in order, the host's in the lower half; a null has none."""
    found = pc.extract_regex(pc.utf8_lower(pc.utf8_trim_whitespace(pc.fill_null(urls, ""))), URL)
    out = []
    for salt, part in enumerate((pc.replace_substring_regex(pc.struct_field(found, "host"), r"^www\.", ""), pc.struct_field(found, "path"))):
        marked = pc.binary_join_element_wise(pc.if_else(pc.is_valid(urls), "^", ""), part, pc.if_else(pc.is_valid(urls), "$", ""), "").cast(pa.large_binary())
        offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
        data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
        row = np.repeat(np.arange(len(marked)), np.diff(offsets))
        for n in SIZES:
            if len(data) < n:
                continue
            h = np.full(len(data) - n + 1, 1469598103934665603 + 2 * n + salt, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(1099511628211)
                h ^= h >> np.uint64(29)
            inside = row[: len(h)] == row[n - 1 :]
            out.append(row[: len(h)][inside] << BITS | (h[inside] & np.uint64((1 << BITS - 1) - 1)).astype(np.int64) | salt << BITS - 1)
    key = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return key >> BITS, key & (1 << BITS) - 1


def values(row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """1 / sqrt(n-grams of the same part of the same URL)."""
    part = 2 * row + (place >> BITS - 1)
    return 1 / np.sqrt(np.bincount(part))[part] if len(part) else np.zeros(0)


def train(rows: list[tuple[str | None, int | None]]) -> np.ndarray:
    """Weights, with the bias in the last place; rows with a null are left out."""
    rows = [(u, y) for u, y in rows if u is not None and y is not None]
    w = np.zeros((1 << BITS) + 1)
    if not rows:
        return w
    row, place = features(pa.array([u for u, _ in rows], pa.string()))
    value = values(row, place)
    y = np.array([bool(y) for _, y in rows], float)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both classes weigh the same
    step = np.zeros_like(w)
    for _ in range(STEPS):
        error = share * (1 / (1 + np.exp(-(w[-1] + np.bincount(row, w[place] * value, minlength=len(rows))))) - y)
        step = 0.9 * step - RATE * np.append(np.bincount(place, error[row] * value, minlength=1 << BITS) + DECAY * w[:-1], error.sum())
        w += step
    return w


def probabilities(urls: pa.Array, w: np.ndarray) -> np.ndarray:
    row, place = features(urls)
    return 1 / (1 + np.exp(-(w[-1] + np.bincount(row, w[place] * values(row, place), minlength=len(urls)))))


def scored(pages: DataFrame, labelled: list[tuple[str | None, int | None]] | None = None) -> DataFrame:
    """page_id, url, p_bad, bad: a row for each row of pages."""
    small_batches(pages.sparkSession)
    w = train(labelled_urls() if labelled is None else labelled).astype(np.float32)

    def run(batches):
        for batch in chunks(batches, "url", rows=ROWS):
            urls = batch.column("url")
            p, null = probabilities(urls, w), urls.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), urls, pa.array(p, pa.float64(), mask=null), pa.array((p > THRESHOLD) & ~null)], names=["page_id", "url", "p_bad", "bad"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, "page_id long, url string, p_bad double, bad boolean")
