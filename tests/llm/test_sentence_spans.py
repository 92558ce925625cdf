import random
from collections import defaultdict

from tests.llm.helpers import documents, edge_rows
from tests.llm.test_suffix_dedup import prose

from loomline.llm.sentence_spans import LONGEST, MIN_WORDS, SPAN, remove_repeated_sentences, sentences


def split(text):
    """Starts, words and counts of a text's sentences."""
    raw = text.encode()
    starts, cuts, line, counts = sentences(raw)
    joined = [line[a : b - 1].decode() for a, b in zip(cuts, [*cuts[1:], len(line) + 1])]
    return [len(raw[:a].decode()) for a in starts], joined, counts


def brute(rows):
    units = [split(t or "")[1] for _, t, _ in rows]
    places = defaultdict(set)
    for (i, t, _), u in zip(rows, units):
        for a in range(len(u)):
            for b in range(a + SPAN, len(u) + 1):
                words = " ".join(u[a:b]).split(" ")
                if len(words) >= MIN_WORDS:
                    shorter = [u[a : b - 1], u[a + 1 : b]]
                    if len(u[a : b - 1]) >= SPAN and len(" ".join(u[a : b - 1]).split(" ")) >= MIN_WORDS:
                        break
                    least = any(len(s) < SPAN or len(" ".join(s).split(" ")) < MIN_WORDS for s in shorter)
                    if least:
                        places[" ".join(words)].add((i is not None, i or 0, t or "", a, b))
    out = []
    for (i, t, _), u in zip(rows, units):
        gone = set()
        for found in places.values():
            first = min((x[0], x[1], x[3]) for x in found)
            for has, j, s, a, b in found:
                if (has, j, s) == (i is not None, i or 0, t or "") and (has, j, a) != first:
                    gone |= set(range(a, b))
        out.append((i, len(gone), sorted(gone)))
    return out


def test_sentences():
    starts, joined, counts = split("One two. Three!\n\n four five?  six.seven")
    assert joined == ["One two.", "Three!", "four five?", "six.seven"] and counts == [2, 1, 2, 1]
    text = " ".join(f"w{k}" for k in range(45))
    starts, joined, counts = split(text)
    assert sum(counts) == 45 and len(counts) > 2 and " ".join(joined) == text and [text[s:].split()[0] for s in starts] == [j.split()[0] for j in joined]
    assert split("a \t b\u00a0c.  d\r\n e")[:2] == ([0, 10, 14], ["a b\u00a0c.", "d", "e"])
    assert split("") == ([], [], [])
    assert split("a " * 100)[2] == [LONGEST, LONGEST, 20]  # nothing tells its words apart


def test_passages_inside_sentences_are_found(spark):
    """A passage of 51 to 100 words glued into two unpunctuated texts, at every offset, goes from the later one, but for its edges."""
    rnd = random.Random(7)
    rows, lengths = [], {}
    for k in range(50):
        passage, n = prose(rnd, 51 + k), 51 + k
        rows += [(2 * k, prose(rnd, 30 + k % 7) + " " + passage + " " + prose(rnd, 25), "a"), (2 * k + 1, prose(rnd, k) + " " + passage + " " + prose(rnd, 60 - k), "a")]
        lengths[2 * k + 1] = n
    shares = []
    for r in remove_repeated_sentences(documents(spark, rows)).collect():
        gone = len(r.row.text.split()) - len(r.repeats.kept.split())
        if r.row.doc_id % 2 == 0:
            assert gone == 0
        else:
            shares.append(gone / lengths[r.row.doc_id])
            assert gone <= lengths[r.row.doc_id]
    assert sum(x >= 0.6 for x in shares) >= 0.9 * len(shares) and sum(x > 0 for x in shares) >= 0.98 * len(shares)


def test_against_brute_force(spark):
    rnd = random.Random(2)
    line = lambda n: prose(rnd, n).capitalize() + ". "
    shared = "".join(line(rnd.randrange(3, 12)) for _ in range(9))
    one = line(70)
    rows = edge_rows()
    for k in range(20):
        rows.append((100 + k, "".join(line(rnd.randrange(1, 9)) for _ in range(4)) + (shared if k % 3 else one) + "".join(line(5) for _ in range(4)), "a"))
    rows += [(200, "Ab. " * 60, "a"), (201, shared, "a"), (50, shared.replace(". ", ".\n"), "b")]
    docs = documents(spark, rows)
    got = [(r.row.doc_id, r.repeats.n_removed, r.repeats.removed) for r in remove_repeated_sentences(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    by = {r.row.doc_id: r for r in remove_repeated_sentences(docs).collect()}
    assert by[201].repeats.kept == "" and by[50].repeats.n_removed == 0 and by[50].row.size == "x"
    assert remove_repeated_sentences(documents(spark, [])).count() == 0
