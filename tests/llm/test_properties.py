"""Properties of the operators' building blocks."""

import io
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidalspan.llm import lz_fingerprint, mixing, packing, simhash, substring, warc

any_text = st.text(max_size=300)


@given(st.lists(st.integers(1, 300), max_size=80), st.sampled_from([1, 16, 64]))
@settings(deadline=None)
def test_packed_ids_lie_in_one_piece_each(lengths, capacity):
    packer, at = packing.Packer(capacity), 0
    for k, n in enumerate(lengths):
        packer.add(k, np.arange(n, dtype=np.int32))
    packer.finish()
    assert all(sum(map(len, s)).bit_count() == 1 for s in packer.out)
    for k, n in enumerate(lengths):
        mine = sorted((p for s in packer.out for p in s if p.doc_id == k), key=lambda p: p.start)
        assert [i for p in mine for i in p.ids.tolist()] == list(range(n)) and all(p.ids[0] == p.start for p in mine)


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\u00a0'sdmtlver1aé🙂")), max_size=200))
@settings(deadline=None, max_examples=300)
def test_quick_ids_are_the_library_s(text):
    import public_tokenizers

    own = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert own.ids(text, 1).tolist() == [*own.whole.encode(text, add_special_tokens=False).ids, 1]


@given(any_text, any_text)
def test_likeness_is_symmetric_and_one_for_equals(a, b):
    x, y = lz_fingerprint.Parsed(a), lz_fingerprint.Parsed(b)
    assert lz_fingerprint.likeness(x.signature, x.signature) == 1
    assert lz_fingerprint.likeness(x.signature, y.signature) == lz_fingerprint.likeness(y.signature, x.signature)
    text, found = x.edited(b)
    assert (found == lz_fingerprint.Parsed(text).signature).all()  # parsing on from the middle changes nothing


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_packed_runs_come_back(values):
    h = np.array(sorted(values), np.uint64)
    c = (h >> np.uint64(7)).astype(np.uint32)
    a, b = substring.unpack(substring.pack(h, c))
    assert (a == h).all() and (b == c).all()


@given(st.lists(st.text(alphabet="ab \n", max_size=40), max_size=6), st.integers(1, 4))
@settings(deadline=None)
def test_a_block_finds_its_repeats(texts, length):
    block = substring.Block(texts, length)
    gone = block.covered(np.zeros(len(block.h), bool))
    seen, want = set(), []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        mask = [False] * len(w)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            if key in seen:
                mask[k : k + length] = [True] * length
            seen.add(key)
        want += mask
    assert gone.tolist() == want


@given(st.lists(st.tuples(st.integers(0, 1000), st.sampled_from([1, 2, 3])), min_size=1, max_size=12))
def test_targets_are_shared_out(given_):
    sizes, weights = [s for s, _ in given_], [w for _, w in given_]
    found = mixing.targets(sizes, weights, 1.5 * sum(sizes))
    assert all(t <= 2 * s + 1e-6 for t, s in zip(found, sizes, strict=True)) and abs(sum(found) - 1.5 * sum(sizes)) < 1e-6


@given(st.lists(st.integers(0, 200), min_size=1, max_size=6), st.integers(1, 9))
@settings(deadline=None)
def test_splitting_tree_keeps_quotas(quotas, shards):
    leaves = mixing.split(quotas, shards)
    assert len(leaves) == shards and [sum(x) for x in zip(*leaves, strict=True)] == quotas and min(map(min, leaves)) >= 0


@given(st.lists(st.tuples(st.integers(), any_text, any_text), max_size=4), st.integers(1, 50))
@settings(deadline=None)
def test_records_come_back(pages, chunk):
    import zlib

    data = b""
    for page_id, url, html in pages:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data += packer.compress(warc.page_record(page_id, url, html, None)) + packer.flush()
    found = [warc.parse(m) for m in warc.members(io.BytesIO(data), chunk)]
    assert [(int(f["x-page-id"]), b.partition(b"\r\n\r\n")[2].decode("utf-8", "surrogatepass")) for f, b in found] == [(p, h) for p, _, h in pages]


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(0, 12))
def test_tiles_link_what_is_near(values, radius):
    fp = np.array(values, np.uint64)
    root = simhash.links(fp, None, np.zeros(len(fp), np.int64), radius, 0.0, step=7)
    label = list(range(len(fp)))
    for _ in fp:
        for a in range(len(fp)):
            for b in range(a):
                if (values[a] ^ values[b]).bit_count() <= radius:
                    label[a] = label[b] = min(label[a], label[b])
    assert len({(r, w) for r, w in zip(root.tolist(), label, strict=True)}) == len(set(root.tolist())) == len(set(label))
