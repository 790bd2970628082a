"""Groups of near fingerprints against all pairs, where a band is shared by many documents."""

import random

import pytest

from lakeledger.llm import edit_fingerprints
from lakeledger.llm.edit_fingerprints import fingerprints, likeness


def by_all_pairs(prints, least=0.8):
    """The smallest of each fingerprint's component over all pairs of at least this likeness, and the number of pairs."""
    prints, n = sorted(set(prints)), 0
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(prints):
        for b in prints[:k]:
            if likeness(a, b) >= least:
                n += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in prints}, n


def groups(spark, prints):
    df = spark.createDataFrame([(x,) for x in prints], "fingerprint string")
    return {row.fingerprint: row.group for row in edit_fingerprints.fingerprint_groups(df).collect()}


def crowded(seed=3):
    """Fingerprints whose first half is the same; near ones share no other band, and others are sorted between them."""
    rng = random.Random(seed)
    header = [rng.choice("0123456789abcdef") for _ in range(64)]
    found = ["00" + "".join(["0", *header[1:], *rng.choices("0123456789abcdef", k=64)]) for _ in range(2)]
    for _ in range(60):
        found.append("00" + "".join([rng.choice("3456789ab"), *header[1:], *rng.choices("0123456789abcdef", k=64)]))
    # one digit of every band of the second half, at the fingerprints' own level and at the next
    upper = [k for k in range(128) if edit_fingerprints.STEPS.level[k] >= 1]
    broken = {group[-1] for group in (upper[k : k + 4] for k in range(0, len(upper), 4)) if group[-1] >= 64}
    broken |= {k for k in range(64, 128, 4) if not broken & set(range(k, k + 4))}
    for _ in range(6):
        rest = rng.choices("0123456789abcdef", k=64)
        other = [f"{int(x, 16) ^ 5:x}" if k + 64 in broken else x for k, x in enumerate(rest)]
        found += ["00" + "".join(["1", *header[1:], *rest]), "00" + "".join(["f", *header[1:], *other])]
    return found


@pytest.mark.parametrize("cell", [1024, 8])
def test_near_fingerprints_of_a_crowded_band_meet(spark, monkeypatch, cell):
    monkeypatch.setattr(edit_fingerprints, "CELL", cell)
    prints = crowded()
    wanted, n = by_all_pairs(prints)
    assert n >= 6 and groups(spark, prints) == wanted


def test_recall_with_a_shared_header(spark):
    rng = random.Random(5)
    words = [f"{rng.choice('abcdefgh')}{k}" for k in range(300)]
    header = " ".join(rng.choices(words, k=60))
    texts = ["", "a", "ab", "abc", "abd", "abcd", "abce", "xbcdef", "abcdef", "abcdeg"]
    for _ in range(60):
        text = header + " " + " ".join(rng.choices(words, k=rng.choice((20, 60, 120))))
        texts.append(text)
        for edits in (1, 3, 6):
            changed = list(text)
            for at in rng.sample(range(len(changed)), edits):
                changed[at] = rng.choice(["", "q", "zz"])
            texts.append("".join(changed))
    prints = fingerprints(texts)
    wanted, n = by_all_pairs(prints)
    print("pairs of likeness 0.8:", n)
    assert n > 40 and groups(spark, prints) == wanted
