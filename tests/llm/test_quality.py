import re
from collections import Counter, defaultdict

from lexlake.llm import quality as Q

from .conftest import EDGES, make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, under = Counter(grams), set()
    for k, g in enumerate(grams):
        if often[g] > 1:
            under.update(range(k, k + 8))
    failed = len(words) < 20 or 100 * len(under) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(under), failed


def normal(line):
    return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()))


def brute(rows):
    """rows: (doc_id, text, host), distinct documents told apart by their whole texts (exact copies count once)."""
    lines, hosts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        host = host or ""
        hosts[host].add(text or "")
        for x in (text or "").split("\n"):
            if WORD.search(x):
                lines[host, normal(x)].add(text or "")
    out = []
    for doc_id, text, host in rows:
        host = host or ""
        removed = 0
        for x in (text or "").split("\n"):
            docs = len(lines.get((host, normal(x)), ()))
            if WORD.search(x) and docs > Q.LINE_DOCS and docs > Q.LINE_SHARE * len(hosts[host]):
                removed += len(WORD.findall(x))
        own = base(text)
        left = own[0] - removed
        out.append((str(doc_id), *own, not own[5] and left >= 20 and left >= 0.2 * own[0], removed))
    return sorted(out)


def got(frame):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]
    return sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in frame.collect())


def test_edges(edge_docs, no_docs):
    rows = [(r[0], r[1], r[3] if len(r) > 2 else "s") for r in EDGES]
    assert got(Q.judge(edge_docs)) == brute(rows)
    assert Q.judge(no_docs).collect() == [] and Q.keep_good(no_docs).collect() == []


def test_base_of_documents(docs):
    found = {r["doc_id"]: r for r in Q.judge(docs).collect()}
    for r in docs.collect():
        f = found[r["doc_id"]]
        assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"], f["base_failed"]) == base(r["text"])


def unique_lines(k, n):
    """Lines that no other k has, by letters: normalising makes all numbers alike."""
    name = lambda x: "".join("abcdefghij"[int(c)] for c in str(x))
    return "\n".join(f"w{name(k)}x{name(i)} alpha{name(k * i)} beta{name(k + i)} gamma{name(i)} delta{name(k)}q eps{name(k)}z{name(i)}" for i in range(n))


def test_boilerplate_is_removed_and_depleted_documents_go(spark):
    menu = "home about contact us terms of use privacy and cookies for all of our many visitors since 1999"
    more = "subscribe to our newsletter today and never miss any of the news again dear reader number 7"
    rows = [(k, menu + "\n" + more + "\n" + unique_lines(k, 6), "en", "a") for k in range(40)]
    rows += [(100, menu + "\n" + more, "en", "a"), (101, menu + "\n" + more.replace("7", "12"), "en", "a"), (102, menu + "\n" + more, "en", "b")]
    rows += [(200 + k, menu + "\n" + more + "\n" + unique_lines(999, 9), "en", "c") for k in range(30)]  # copies of one page
    found = {r["doc_id"]: r for r in Q.judge(make_docs(spark, rows)).collect()}
    assert all(found[k]["kept"] and found[k]["removed_words"] == len((menu + " " + more).split()) for k in range(40))
    assert not found[100]["kept"] and not found[101]["kept"], "nothing but boilerplate is left"
    assert found[102]["kept"], "another host"
    assert all(found[200 + k]["kept"] and found[200 + k]["removed_words"] == 0 for k in range(30)), "copies don't make boilerplate"
    left = Q.keep_good(make_docs(spark, rows))
    assert {r["doc_id"] for r in left.collect()} == {k for k, r in found.items() if r["kept"]} and "_key" in left.columns


def test_pages_that_share_a_passage_are_different_documents(spark):
    passage = "\n".join(unique_lines(7, 40).split("\n"))
    rows = [(k, passage + "\n" + unique_lines(1000 + k, 4), "en", "a") for k in range(40)]  # 10 in 11 words are shared
    rows += [(100 + k, ("  " * k + unique_lines(500, 9)).upper(), "en", "b") for k in range(30)]  # copies, white space aside
    found = {r["doc_id"]: r for r in Q.judge(make_docs(spark, rows)).collect()}
    assert all(found[k]["removed_words"] == len(passage.split()) and not found[k]["kept"] for k in range(40))
    assert all(found[100 + k]["removed_words"] == 0 and found[100 + k]["kept"] for k in range(30))


def test_hosts_of_any_size_and_lines_of_any_length_are_judged_alike(spark):
    """Pages of one long shared line and a few own words go, however many they are."""
    def pages(n, shared, own, first):
        line = " ".join(f"s{i}" for i in "abcdefghijklmnopqrstuvwxyz" for _ in range(1 + shared // 26))
        return [(first + k, line + "\n" + unique_lines(first + k, 1 + own // 7), "en", f"h{first}") for k in range(n)]

    cases = [(60, 60, 2), (60, 300, 5), (300, 600, 5), (300, 60, 5)]
    rows = [r for c, (n, shared, own) in enumerate(cases) for r in pages(n, shared, own, 1000 * c)]
    found = Q.judge(make_docs(spark, rows)).collect()
    assert not any(r["kept"] for r in found) and all(r["removed_words"] > 0 for r in found)
    assert got(Q.judge(make_docs(spark, rows))) == brute([(r[0], r[1], r[3]) for r in rows])


def test_rejected_rows_go_though_others_with_their_id_pass(spark):
    rows = [(None, unique_lines(1, 6)), (None, "too short"), (7, unique_lines(2, 6)), (7, "short too"), (7, unique_lines(2, 6)), (8, "short")]
    left = Q.keep_good(make_docs(spark, rows))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(rows[k] for k in (0, 2, 4))
