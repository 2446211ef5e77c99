"""What only shows on larger tables."""

import numpy as np

from millrace.llm import pfp


def test_phrases_of_ten_gigabytes_are_dealt_once():
    assert pfp._salts(10 << 30, pfp.MEET) == 1 < pfp._salts(100 << 30, pfp.MEET)


def test_entries_come_back_and_places_pack():
    rng, n = np.random.default_rng(3), 2000
    for kind in (pfp.PHRASE, pfp.WINDOW):
        entries = np.zeros(n, kind)
        for c in kind.names:
            entries[c] = rng.integers(0, 200, entries[c].shape)
        entries["pos"] = rng.integers(0, 2**32, n)
        ids, tags, part = np.arange(200) * 3 - 7, rng.integers(0, 2**32, 200), rng.integers(0, 3, n)
        blobs = [d for b in pfp._packed("phrase", part, entries, ids, tags) for d in b.column("data").to_pylist()]
        got, doc, own, marks = pfp._unpacked(blobs, kind)
        told = lambda e, d, t: sorted((int(i), int(g), *(np.array(r[c]).tobytes() for c in kind.names if c != "doc")) for r, i, g in zip(e, d, t, strict=True))
        assert told(got, own[doc], marks[doc]) == told(entries, ids[entries["doc"]], tags[entries["doc"]])
    entries = np.zeros(n, pfp.PHRASE)
    entries["ident"], entries["doc"], entries["pos"] = rng.integers(0, 2**63, n), np.arange(n) // 10, np.arange(n) % 10 * 16
    blobs = [d for b in pfp._packed("phrase", np.zeros(n, np.int64), entries, np.arange(200), np.zeros(200, np.int64)) for d in b.column("data").to_pylist()]
    assert sum(map(len, blobs)) < 16 * n
