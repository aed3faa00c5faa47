"""The kernels against plain Python."""

import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import decontamination, lane_coder, multiset_fingerprint, recompress_core, site_style_tree, stream_coder, token_binary
from corpusloom.llm.bpe_prefix import PrefixBpe
from corpusloom.llm.fingerprints import shingle_hashes, simhash
from corpusloom.llm.simhash_dedup import AGREE, group_masks

TEXT = st.text(alphabet=" abeé'\n\t!<>|endoftx1中日\U0001f600-=*\x1c\x85ß²ΣİÀ", max_size=60)


@pytest.fixture(scope="module")
def bpe():
    return PrefixBpe(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_prefix_encoding_is_the_librarys(bpe, libraries, text):
    ids = libraries["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == ids
    assert bpe.decode(ids) == libraries["byte_bpe_50k.json"].decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "a" * 5000, " " * 4000 + "x", "<|endoftext|>a<|endoftext|>", "don't 'S", "!" * 700])
def test_prefix_encoding_of_odd_texts(bpe, libraries, text):
    assert bpe.encode(text) == libraries["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_encoding_is_the_librarys(libraries, text):
    mine = token_binary.load(public_tokenizers.path("word_bpe_49k.json")).encode(text)
    assert mine.tolist() == libraries["word_bpe_49k.json"].encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 49407), max_size=120), max_size=6))
def test_lane_coder_round_trip(blocks):
    arrays = [np.array(b, np.int32) for b in blocks]
    back = lane_coder.decode_blocks(lane_coder.encode_blocks(arrays, 49408), [len(b) for b in blocks], 49408)
    assert [b.tolist() for b in back] == blocks


def test_lane_coder_shrinks_repeats():
    block = np.array([5, 9, 700, 41] * 1000, np.int32)
    assert len(lane_coder.encode_blocks([block], 49408)[0]) < 1500


def test_codes_stay_as_files_have_them():
    """Files written by the first form of the coder's tables must be read by any later one."""
    x = (np.arange(6000, dtype=np.int64) ** 2 // 7 % 1013 * 47).astype(np.int32)
    x[::3] = x[0]
    blocks = [x[:4096], x[4096:], x[:0], x[5:6]]
    codes = lane_coder.encode_blocks(blocks, 49408)
    assert [zlib.crc32(c) for c in codes] == [1069575940, 2262924628, 1696784233, 3996713579]
    assert all(np.array_equal(a, b) for a, b in zip(lane_coder.decode_blocks(codes, [len(b) for b in blocks], 49408), blocks, strict=True))


def test_frames_find_damage():
    frame = token_binary.pack([([1, None], [np.array([5, 6, 2], np.int32), np.array([2], np.int32)])], 49408)[0][2]
    assert [(n, i.tolist()) for n, i in next(token_binary.unpack([frame]))] == [(1, [5, 6, 2]), (None, [2])]
    found = 0
    for at in range(1, 15):  # the last bytes of a code may say no more
        try:
            (rows,) = token_binary.unpack([frame[: len(frame) - at] + bytes([frame[-at] ^ 255]) + frame[len(frame) - at + 1 :]])
            assert [(n, i.tolist()) for n, i in rows] == [(1, [5, 6, 2]), (None, [2])]
        except ValueError:
            found += 1
    assert found >= 4
    with pytest.raises(ValueError):
        list(token_binary.unpack([b"x" + frame[1:]]))


def test_frames_of_the_first_form_are_read_beside_others():
    """A file of before holds lane_coder's codes under another name."""
    ids = [np.arange(5000, dtype=np.int32) % 700, np.array([9, 2], np.int32)]
    new = token_binary.pack([([4, 5], ids)], 49408)[0][2]
    whole = np.concatenate(ids)
    blocks = [whole[:4096], whole[4096:]]
    codes = lane_coder.encode_blocks(blocks, 49408)
    table = np.array([[len(b), len(c), zlib.crc32(b.astype("<u4").tobytes())] for b, c in zip(blocks, codes, strict=True)], "<u4")
    old = b"CLF1" + struct.pack("<III", 49408, 2, 2) + bytes(2) + np.array([4, 5], "<i8").tobytes() + np.array([5000, 2], "<u4").tobytes() + table.tobytes() + b"".join(codes)
    want = [(4, ids[0].tolist()), (5, ids[1].tolist())]
    assert [[(n, i.tolist()) for n, i in rows] for rows in token_binary.unpack([new, old, new])] == [want] * 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 49407), max_size=120), max_size=6))
def test_stream_coder_round_trip(blocks):
    arrays = [np.array(b, np.int32) for b in blocks]
    back = stream_coder.decode_blocks(stream_coder.encode_blocks(arrays, 49408), [len(b) for b in blocks], 49408)
    assert [b.tolist() for b in back] == blocks


def test_stream_coder_on_odd_blocks():
    rng = np.random.default_rng(7)
    random_ids = [rng.integers(0, 49408, n).astype(np.int32) for n in (4096, 4095, 1, 15, 16, 17, 33)]
    blocks = [*random_ids, np.full(4096, 49407, np.int32), np.zeros(4000, np.int32), np.arange(4096, dtype=np.int32), np.tile(random_ids[1][:600], 6)]
    codes = stream_coder.encode_blocks(blocks, 49408)
    assert codes == [stream_coder.encode_blocks([b], 49408)[0] for b in blocks]  # a block's code doesn't follow its company
    assert all(np.array_equal(a, b) for a, b in zip(stream_coder.decode_blocks(codes, [len(b) for b in blocks], 49408), blocks, strict=True))
    assert len(codes[7]) < 1500 and len(codes[0]) < 2 * 4096 * 1.1
    with pytest.raises(ValueError):
        stream_coder.encode_blocks([np.array([3, 49408], np.int32)], 49408)


def test_frames_are_smaller_than_deflate_makes_them_and_cheaper_than_the_first_form():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.zipf(1.3, 400_000), 40_000).astype(np.int32)
    ids[1::7] = ids[0:-1:7] * 3 % 40_000
    blocks = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
    at = time.process_time()
    frame = token_binary.pack([([1], [ids])], 40_001)[0][2]
    ((_, back),) = next(token_binary.unpack([frame]))
    mine = time.process_time() - at
    assert np.array_equal(back, ids)
    assert len(frame) < 0.95 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)
    at = time.process_time()
    lane_coder.decode_blocks(lane_coder.encode_blocks(blocks, 40_001), [len(b) for b in blocks], 40_001)
    assert mine < 0.5 * (time.process_time() - at)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, st.text(alphabet="abstremdvlABSTé' 12\n\x85\xa0.,-µß²", max_size=60)), max_size=8))
def test_word_encoding_of_many_texts_is_the_librarys(libraries, texts):
    mine = token_binary.load(public_tokenizers.path("word_bpe_49k.json")).encode_all(texts)
    assert [i.tolist() for i in mine] == [e.ids for e in libraries["word_bpe_49k.json"].encode_batch(texts, add_special_tokens=False)]


def test_many_texts_need_no_call_for_each(monkeypatch):
    """Texts of one-byte characters are split together, so no text goes through the encoder of single texts."""
    tokenizer = token_binary.load(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"Don't say 'x{i}' to Zoë, {i * 37} times" for i in range(300)] + [""]
    want = [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokenizer, "encode", None)
    assert [i.tolist() for i in tokenizer.encode_all(texts)] == want


def test_remembered_pieces_are_bounded_and_right(monkeypatch):
    monkeypatch.setattr(token_binary, "KNOWN", 40)
    tokenizer = token_binary.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    calls = []
    encode = tokenizer.known.encode
    monkeypatch.setattr(tokenizer.known, "encode", lambda piece: calls.append(piece) or encode(piece))
    for i in range(30):
        texts = [f"often said w\xf6rd{chr(97 + i % 26)}{chr(97 + i // 2)} {i}", "x" * 300 if i == 20 else "", "  "]
        assert [x.tolist() for x in tokenizer.encode_all(texts)] == [e.ids for e in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert len(tokenizer.known.pieces) <= 40 and tokenizer.known.sizes.sum() == len(tokenizer.known.ids)
    assert calls.count(b"often") == calls.count(b"said") == 1  # what is met again and again stays
    assert b"x" * 300 in calls


def test_all_texts_of_every_character():
    tokenizer = token_binary.load(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t for c in map(chr, range(0x400)) for t in (c, f"a{c}b", f"Ab {c}{c} 'S 12{c}", f"{c}'re{c}'ll'd")]
    assert [i.tolist() for i in tokenizer.encode_all(texts)] == [e.ids for e in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]


def plain_simhash(text, width):
    import xxhash

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    value = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("text", [None, "", " \n", "A", "a b c", "a b c d", " é\x85B\xa0c d E f", "x " * 3000, "one Two three FOUR five six"])
def test_simhash(text):
    assert simhash(shingle_hashes(text, 4)) == plain_simhash(text, 4)


def test_close_fingerprints_agree_on_groups():
    rng = random.Random(3)
    low = 0x5555555555555555
    embed = lambda x: ((x & low) ^ (x >> 1 & low)) | ((x & x >> 1 & low) << 1)
    masks = [m % (1 << 64) for m in group_masks(4)]
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), 4):
            b ^= 1 << k
        differ = embed(a) ^ embed(b)
        assert sum(differ & m == 0 for m in masks) >= AGREE


def test_equal_windows_have_equal_symbols():
    rng = random.Random(5)
    for _ in range(60):
        docs = [b" ".join(rng.choice([b"a", b"a", b"bb", b"cc", b"d%d" % rng.randint(0, 30)]) for _ in range(rng.randint(0, 60))) for _ in range(4)]
        words = recompress_core.Words(docs)
        for width in (1, 5, 13):
            seen = {}
            keys, starts, ends, texts = recompress_core.segments(words, width)
            for key, start, end, text in zip(keys.tolist(), starts.tolist(), ends.tolist(), texts.tolist(), strict=True):
                for at in range(start, end):
                    assert at + width <= words.offsets[text + 1]
                    assert seen.setdefault(tuple(words.names[at : at + width].tolist()), key) == key
            windows = sum(max(0, len(d.split()) - width + 1) for d in docs)
            assert int((ends - starts).sum()) == windows


def thue_morse(n, letters):
    return [letters[bin(i).count("1") & 1] for i in range(n)]


def test_names_of_words_that_polynomials_take_for_equal():
    for n in (8, 64, 512, 1024, 4096):
        a, b = ("".join(thue_morse(n, x)).encode() for x in ("ab", "ba"))
        words = recompress_core.Words([a + b" " + b, b"", b + b"  \t" + a])
        names = words.names.tolist()
        assert len(set(names)) == 2 and names[2:] == names[1::-1]
        assert words.offsets.tolist() == [0, 2, 2, 4] and words.sizes.tolist() == [n] * 4
    pairs = recompress_core.Words([b"a bc", b"a\n bc", b"ab c"]).digests(np.array([0, 2, 4]), np.array([2, 4, 6]), b"k")
    assert pairs[0] == pairs[1] != pairs[2]


def plain_alignment(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] > 0 else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(map(max, table))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=20))
def test_alignment(item, passage):
    score, start, end = decontamination.align(np.array(item), np.array(passage, int))
    assert score == plain_alignment(item, passage)
    assert plain_alignment(item, passage[start:end]) == score


def test_edited_copy_is_found_and_others_are_not():
    item = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree"
    items = decontamination.Items([(7, item), (8, "")], 0.5)
    items.choose(np.ones(len(items.vocabulary) + 1, np.int64))
    one = lambda text: [m[1] for m in items.matches([text])]
    edited = "intro words here " + item.replace("lazy", "sleepy").replace("seven wise", "many") + " and an end"
    assert one(edited) == [7]
    assert one("the quick brown fox went home and nothing else of it is here at all today") == []
    assert one(None) == one("") == items.matches([]) == []


def test_multiset_hash_is_homomorphic():
    f = multiset_fingerprint.fingerprint
    ab, ba = f("one two\nthree four five"), f("three four five\none two")
    assert ab.digest() == ba.digest() and ab.likeness(ba) == 1.0
    assert (f("x y") + f("z")).digest() == f("z\nx y").digest()
    assert (f("a\nb\nc") - f("b")).digest() == f("c\na").digest()
    assert f("a\na").digest() != f("a").digest()
    assert f(None).digest() == f("").digest()
    long = " ".join(f"w{i}" for i in range(400))
    assert f(long).likeness(f(long + " more words at the end")) > 0.9 > 0.2 > f(long).likeness(f(" ".join(f"v{i}" for i in range(400))))


def test_article_is_read_and_noise_is_not():
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var x='<p>no</p>'</script></head><body><nav><ul><li>menu</ul></nav><!-- no -->"
        '<div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>First<br>  block<p>second &lt;x&gt;</p><form><p>no</p></form><div id="comments">no</div></article><footer>end</footer>'
    )
    assert site_style_tree.main_text(site_style_tree.read(page).blocks, set()) == "Head & line\n\nFirst block\n\nsecond <x>"
    assert site_style_tree.read(None).blocks == site_style_tree.read("").blocks == []
    assert site_style_tree.main_text(site_style_tree.read("a < b <c").blocks, set()) == "a < b <c"


@pytest.mark.parametrize("start", ['<article><div class="social-sciences">', '<main><div id="content-side">', '<article><div class="legal-history">', '<article><section id="related-work">', '<article><div class="search-results">'])
def test_names_of_articles_are_no_noise(start):
    assert site_style_tree.main_text(site_style_tree.read(f"<body>{start}<p>text").blocks, set()) == "text"


@pytest.mark.parametrize("start", ['<div class="site-header">', '<div id="comment-list">', '<div class="x ad">', '<section class="related posts related-posts">', '<div role="navigation">'])
def test_names_of_noise(start):
    assert site_style_tree.main_text(site_style_tree.read(f"<body>{start}<p>no</p></div></section><p>text").blocks, set()) in ("text", "")


@pytest.mark.parametrize("part", ['<div class="abcdefgh">', "<a ", "<b>", "<b><h1></h1>", "<p><b>", "<li>", '<a "', "<a '>", "<!", "</x", "<script>", "<!--", "&amp", "<table><tr><td>", "</div>"])
def test_hostile_pages_take_linear_time(part):
    import time

    def seconds(n):
        page = "start" + part * n
        began = time.process_time()
        site_style_tree.main_text(site_style_tree.read(page).blocks, set())
        return time.process_time() - began

    seconds(1000)
    assert seconds(80_000) < 12 * seconds(20_000) + 0.5  # four times the length; sixteen times the time if it were quadratic


def test_word_ids_of_every_character():
    """Each character of the Basic Multilingual Plane alone, between letters and after a capital, as the library has it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = token_binary.load(path)
    texts = [t for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 for t in (c, f"a{c}b", f"Ab {c}{c} 'S 12{c}")]
    texts += ["a\u023ab", "\u023e", "\u0130x", "x\u03a3", "e\u0301", "<|startoftext|>x<|endoftext|>"]
    want = tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, want, strict=True) if tokenizer.encode(t).tolist() != w.ids]
    assert wrong == []


def test_blocks_are_smaller_than_deflate_makes_them():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.zipf(1.3, 200_000), 40_000).astype(np.int32)
    ids[1::7] = ids[0:-1:7] * 3 % 40_000  # pairs that the last id predicts
    blocks = [ids[i : i + lane_coder.BLOCK] for i in range(0, len(ids), lane_coder.BLOCK)]
    codes = lane_coder.encode_blocks(blocks, 40_000)
    assert all(np.array_equal(a, b) for a, b in zip(lane_coder.decode_blocks(codes, [len(b) for b in blocks], 40_000), blocks, strict=True))
    assert sum(map(len, codes)) < 0.95 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)


def test_names_inside_an_article_drop_neither_headings_nor_sections():
    html = """<body><div class="header">Site</div><nav>menu</nav><article><h1 class="header">Title</h1><div class="section-header">Part one</div><p>Text.</p>
      <section class="legal"><p>The law says so.</p></section><h2 class="comments">On comments</h2><div class="ad">Buy</div><div id="comments"><p>first!</p></div><ul class="share"><li>post</li></ul><footer>by me</footer></article></body>"""
    assert site_style_tree.main_text(site_style_tree.read(html).blocks, set()) == "Title\n\nPart one\n\nText.\n\nThe law says so.\n\nOn comments"
