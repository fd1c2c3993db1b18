import numpy as np

from lodestone.llm import suffixes


def test_suffixes_that_differ_in_a_word_need_no_hashes(monkeypatch):
    r = np.random.default_rng(3)
    data = np.frombuffer(r.integers(97, 123, 4000, np.uint8).tobytes() + b"same bytes for both of them, all along the window it is " * 3, np.uint8)
    suffix = np.arange(len(data) - suffixes.WINDOW)
    sorter, asked = suffixes.SuffixSorter(data), []
    plain = sorter.extension
    monkeypatch.setattr(sorter, "extension", lambda x, y, *least: asked.append(len(x)) or plain(x, y, *least))
    n = len(suffix)
    got = sorter.sort(suffix, np.zeros(n, np.int64), np.full(n, n))
    window = lambda i: data[i : i + suffixes.WINDOW].tobytes()
    assert [window(i) for i in got.tolist()] == sorted(map(window, suffix.tolist()))
    assert sum(asked) < n


def test_equal_hashes_of_unequal_stretches_stop_the_job():
    data = np.frombuffer(b"a" * 60 + b"a" * 55 + b"b" * 5 + b"a" * 60, np.uint8)
    words = suffixes.SuffixSorter(data).head
    at, size = np.array([0, 120]), np.array([60, 60])
    suffixes.check(words, at, size, np.array([True, False]))
    for a in ([0, 60], [60, 0]):
        try:
            suffixes.check(words, np.array(a), size, np.array([True, False]))
        except ArithmeticError:
            continue
        raise AssertionError
