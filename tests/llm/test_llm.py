"""The training-data operators against brute force, exact round trips, held-out cases and the defined edge cases."""

import base64
import cProfile
import random

import numpy as np
import pytest

from lexmill.llm import bpe, lattice, lookalike, mojibake, neardup, packing, queries, residue, scans, split

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNKS = "chunk_id bigint, config_id int, heading_path string, text string, limit int, form string"
RESULTS = "result_id bigint, engine string, text string, confidences array<double>, second_text string, form string"


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- 6: encoding


def test_ids_equal_the_library_on_random_texts(reference):
    rng = random.Random(1)
    letters = "ab 'stredvlm’\n\t  12½中文éß😀　\xa0--.,=​Ж"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 1500 + "b", "=" * 3000, "it's I'll we've'd'", "中" * 900, "<|endoftext|>", " ", "\n\n \n", "", None]
    words = bpe.Encoder.of().encode_words(texts)
    counts, flat = words.tokens_of_texts(len(texts)), words.flat_ids().tolist()
    at = 0
    for text, n in zip(texts, counts.tolist()):
        assert flat[at : at + n] == reference.encode_ordinary(text or ""), text
        at += n


def test_words_of_one_hash_keep_their_own_ids(reference):
    """Thue-Morse words and their complements have the same polynomial hash modulo 2^64, whatever its base."""
    texts = []
    for bits in range(9, 14):
        for swap in ("ab", "ba"):
            word = "".join(swap[i.bit_count() % 2] for i in range(1 << bits))
            texts += [word, "x" + word, word + " " + word[: 1 << 8]]
    words = bpe.Encoder.of().encode_words(texts)
    at, flat = 0, words.flat_ids().tolist()
    for text, n in zip(texts, words.tokens_of_texts(len(texts)).tolist()):
        assert flat[at : at + n] == reference.encode_ordinary(text), (text[:4], len(text))
        at += n


def test_encode_keeps_all_rows(spark, reference, small):
    rows = [(1, "Hello world"), (2, ""), (3, None), (1, "Hello world"), (4, "  \n"), (5, "合同 " * 20000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as ids", "1 as n_tokens")
    got = sorted((r.doc_id, tuple(r.ids)) for r in bpe.encode(df).collect())
    assert got == sorted((i, tuple(reference.encode_ordinary(t or ""))) for i, t in rows)
    assert bpe.encode(df.limit(0)).count() == 0
    real = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in real.collect()}
    assert all(list(r.ids) == reference.encode_ordinary(texts[r.doc_id] or "") for r in bpe.encode(real).collect())


# --- 1: splitting


def greedy(positions, counts, limit, overlap):
    out, at, last = [], 0, len(positions) - 1
    while True:
        end = max(k for k in range(at + 1, last + 1) if counts[k] - counts[at] <= limit or k == at + 1)
        out.append((at, end))
        if end == last:
            return out
        at = min(next(k for k in range(len(counts)) if counts[k] >= max(counts[end] - overlap, counts[end + 1] - limit)), end)


def test_pieces_are_the_greedy_ones_and_lossless(spark):
    rng = random.Random(2)
    sentence = lambda: "".join(rng.choice("甲乙丙丁合同条款") for _ in range(rng.randint(3, 40))) + rng.choice("。！，") + rng.choice(["", "\n", "\n\n"])
    texts = ["".join(sentence() for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts += ["x" * 3000, "word " * 900, "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 200, "🙂" * 400, "第一条 甲。第二条 乙。" * 60]
    rows = [(i, 1 + i % 3, "A > B", t, 7, "z") for i, t in enumerate(texts)] + [(100, 1, None, None, 0, ""), (101, 1, "", "", 0, ""), (102, 1, None, "short", 0, ""), (103, 9, None, texts[0], 0, ""), (0, 1, "A > B", texts[0], 7, "z")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    configs = spark.createDataFrame([(1, 60, 20), (2, 90, 0), (3, 40, 400), (3, 40, 400)], "config_id int, chunk_tokens int, chunk_overlap int")
    pieces = {}
    for r in split.split_chunks(chunks, configs).collect():
        pieces.setdefault(r.chunk_id, []).append(r)
    encoder = bpe.Encoder.of()
    found = {r.chunk_id for r in split.oversized(chunks, configs).collect()}
    assert found == {i for i, t in enumerate(texts) if encoder.counts([t])[0] > (60, 90, 40)[i % 3]} == set(pieces)
    marks = {r.chunk_id: (list(r.pos), list(r.cum)) for r in split.find_boundaries(chunks, configs).collect()}
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        limit, overlap = [(60, 20), (90, 0), (40, 39)][i % 3]
        assert "".join(r.text[r.overlap_chars :] for r in own) == texts[i]
        assert all(encoder.counts([r.text])[0] <= r.n_tokens <= limit and r.heading_path == "A > B" for r in own)
        assert all(encoder.counts([r.text[: r.overlap_chars]])[0] <= overlap for r in own)
        pos, cum = marks[i]
        places, at = [], 0
        for r in own:
            places.append((at - r.overlap_chars, at - r.overlap_chars + len(r.text)))
            at = places[-1][1]
        assert places == [(pos[a], pos[b]) for a, b in greedy(pos, cum, limit, overlap)]
    assert split.split_chunks(chunks.limit(0), configs).count() == 0


# --- 8: residue

RESIDUE = [
    "住址：{{案号}}", "on the {{ hearing_date }} of", "钱${due_date}焱", "于#{case.承办人}末", "a @@claim_amount@@ b", "共%身份证号%元", "%PARTY_NAME%", "x __JUDGE__ y", "__签署人__", "the <<witness>> said", "at <hearing date> in", "<address>",
    "marked «bank_account» as", "el «juzgado» de", "asks {address} that", "[signatory] is", "[insert case number]", "[bitte Anschrift einsetzen]", "[counsel to be completed]", "(fill in court here)", "【请填写案号】", "【court待补充】", "（此处填写到期日）",
    "Veniam lorem veniam commodo dolor labore nostrud.", "此处为示例文字，请在定稿前替换。", "Text text text text text.", "正文内容正文内容正文内容。", "Blindtext zur Ansicht des Layouts.",
    "# 标题\n\n服务器内部错误 500，请联系管理员\n\n正文。", "Home | Help\n\n404 - the requested file was not found on this server\n\n[OK]", "Les scripts sont désactivés dans votre navigateur", "抱歉，您没有查看该文书的权限", "Ihre Sitzung ist abgelaufen, bitte erneut anmelden",
    "请启⽤浏览器脚本后继续浏览",
]
NO_RESIDUE = [
    "甲方（签章）：________　　日期：____年__月__日", "Signed: ____________  Date: ____________", "证人李某某（姓名已隐去）住××路9号", "见 [[9号合同]] 与 [[付款记录|对账]]", "[emphasis added] [257] [signature illegible]", "证据9为网页截图，页面显示“该页面不存在（404）”，证明被告已删除涉案链接。",
    "验收脚本为 `echo ${HOME}/export/9`，双方对其输出无异议", 'Log entry 9: {"status": 500, "retry": true} was shown to the witness.', 'The specification requires the portal to tell users to "enable JavaScript"; release 9 never did', "模板附件第9条规定，占位字段由系统自动替换",
    "He argued, inter alia and prima facie, that pacta sunt servanda; item 9", "La pièce 9 reproduit le message « page introuvable », preuve du retrait", "El «anexo» de 8 de julio", "年利率16.44%计付逾期利息，另5%计付", "The hearing took place in room 404.", "", "   ", None, "```\n{{x}}\n```",
]


def test_long_code_is_code(spark):
    fence = "```\n" + "x = 1\n" * 1000 + "{{ client }}\n```"
    texts = [fence, f"{fence}\nDear {{{{ client }}}},\n{fence}", "Run `" + "x" * 400 + " {{ client }}` now.", f"{fence}\nDear Ms Ashby,\n{fence}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in residue.find_residue(df).collect()} == {1}


def test_residue(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(RESIDUE + NO_RESIDUE)], "doc_id bigint, text string, residue string")
    found = {r.doc_id for r in residue.find_residue(df).collect()}
    assert [t for i, t in enumerate(RESIDUE) if i not in found] == []
    assert [t for i, t in enumerate(NO_RESIDUE, len(RESIDUE)) if i in found] == []
    kept = residue.exclude_residue(df)
    assert {r.doc_id for r in kept.collect()} == set(range(len(RESIDUE), len(RESIDUE + NO_RESIDUE))) and kept.columns == df.columns
    assert residue.find_residue(df.limit(0)).count() == 0


def test_residue_of_unknown_names_and_messages(spark):
    """Names and messages that no list of the operator has, and texts that only speak of such things."""
    names = ["landlord", "policy", "invoice", "tenant", "vessel name", "notary", "Vermieter", "locataire", "arrendador"]
    shapes = ["Dear [{}], we write", "between [{}] and the bank", "see <{}> for this", "the {{{}}} of May", "of {{{{ {} }}}} and", "sent to ${{{}}} today", "the @@{}@@ says", "Payable by: [{}]"]
    fields = [x.format(n if "$" not in x else n.replace(" ", "_")) for n in names for x in shapes] + [f"Hello %{n.replace(' ', '_')}%," for n in names]
    messages = [
        "You need to enable JavaScript to run this app.", "Bad Request. Your browser sent a request that this server could not understand.", "Sorry, the page you are looking for could not be found.", "Please enable cookies and reload the page.",
        "Your browser does not support JavaScript.", "This site requires cookies to be enabled", "Just a moment while we verify you are not a robot", "Vous devez activer JavaScript pour afficher cette page", "Sie müssen JavaScript aktivieren, um diese Seite anzuzeigen",
        "404 Not Found", "502 Bad Gateway", "Your request could not be processed by the server, try again later", "您的浏览器未启用脚本，无法显示本页面", "Internal server error: the upstream host did not answer in time while it was handling the request with the number 8812, and it was closed after thirty seconds by the gateway, please try again in a moment",
        "foo foo foo foo foo",
    ]
    good = [
        "write {{ client_name }} in the template; the system replaces it", "~~~\n{{ x }}\n~~~", "the parties [emphasis added] agree", "he said [sic] that", "x <b>bold</b> y", "a set {a, b} and {x}", "rate of 5% and 7% of", "The court notes that your browser must be enabled by the server.",
        "see note [12]", "the [original in French] text", "We could not agree on the page numbers.", "This page was left blank.", "The placeholder {{ name }} stands for the client.", "Your session notes from the hearing are attached.", "a [laughs] b",
    ]
    df = spark.createDataFrame(list(enumerate(fields + messages + good)), "doc_id int, text string")
    found = {r.doc_id for r in residue.find_residue(df).collect()}
    n, m = len(fields), len(messages)
    assert sum(i in found for i in range(n)) >= 0.9 * n and sum(i in found for i in range(n, n + m)) >= 0.9 * m
    assert [t for i, t in enumerate(good, n + m) if i in found] == []


# --- 3: look-alikes

SAME = [
    ("Ｓｃｈｅｄｕｌｅ ＨＧ-７", "Schedule HG-7"), ("ramené", "ramené"), ("The\xa0floor", "The floor"), ("a b", "a　b"), ("履⾏费⽤", "履行费用"), ("不金", "不金"), ("ﬁnal", "final"), ("re‑do", "re-do"), ("infоrme", "informe"), ("сору", "copy"),
    ("Ρartners", "Partners"), ("suppleme‌ntary", "supplementary"), ("Прилoжение", "Приложение"), ("е́", "é"), ("（甲），乙：", "(甲),乙:"), ("编号ＳХ-1", "编号SX-1"),
]
DIFFERENT = [("m²", "m2"), ("Abc", "abc"), ("e", "é"), ("日", "曰"), ("a\nb", "a b"), ("、", "，"), ("“a”", '"a"'), ("½", "1/2"), ("№", "No"), ("a  b", "a b"), ("未", "末")]


def test_forms():
    forms = lookalike.Forms({})
    for a, b in SAME:
        assert forms.strings([a]) == forms.strings([b]), (a, b)
    for a, b in DIFFERENT:
        assert forms.strings([a]) != forms.strings([b]), (a, b)
    texts = [a for pair in SAME + DIFFERENT for a in pair] + ["", None, "Приложение к договору", "👨‍👩‍👧"]
    once = forms.strings(texts)
    assert forms.strings(once) == once and once[-4:] == ["", None, "Приложение к договору", "👨‍👩‍👧"]


def test_alike_pairs(spark):
    rows = [(1, "copy of it"), (2, "сору of it"), (3, "copy of it"), (2, "сору of it"), (4, None), (5, ""), (6, "​"), (7, "copy\xa0of it"), (8, "Copy of it"), (9, " ")]
    chunks = spark.createDataFrame([(i, 1, None, t, 1, "f") for i, t in rows], CHUNKS)
    results = spark.createDataFrame([(1, "e", "copy of it", None, None, "x"), (20, "e", "m²", None, None, ""), (21, "e", "m2", None, None, "")], RESULTS)
    got = sorted(tuple(r) for r in lookalike.alike_pairs(chunks, results).collect())
    assert got == [("chunks", 1, 2), ("chunks", 1, 7), ("chunks", 2, 3), ("chunks", 2, 7), ("chunks", 3, 7)]
    groups = {(r.tbl, r.id): (r.group, r.variant, r.n_variants, r.n_rows) for r in lookalike.alike_groups(chunks, results).collect()}
    assert groups == {("chunks", i): (1, 1 if i == 3 else i, 3, 4) for i in (1, 2, 3, 7)}
    assert lookalike.alike_pairs(chunks.limit(0), results.limit(0)).count() == 0 and lookalike.alike_groups(chunks.limit(0), results.limit(0)).count() == 0


def test_a_text_copied_very_often_with_one_disguise(spark):
    n = 100_000
    chunks = spark.range(n + 1).selectExpr("id as chunk_id", f"if(id = {n // 2}, 'сору of it', 'copy of it') as text")
    results = spark.createDataFrame([], RESULTS)
    pairs = lookalike.alike_pairs(chunks, results)
    assert pairs.count() == n == pairs.filter(f"id_a = {n // 2} or id_b = {n // 2}").count()
    assert lookalike.alike_groups(chunks, results).groupBy("group", "variant", "n_variants", "n_rows").count().count() == 2


# --- 5: near-duplicates


def brute(texts):
    forms, out = lookalike.Forms({}), set()
    sets = {}
    for i, t in texts:
        if t is not None:
            s = "".join(c for c in forms.strings([t])[0] if not c.isspace())
            if len(s) >= 80:
                sets[i] = {s[k : k + 5] for k in range(len(s) - 4)}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            k = len(sets[a] & sets[b])
            if k >= 0.6 * (len(sets[a]) + len(sets[b]) - k):
                out.add(("chunks", a, b))
    return out


def variants(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = []
    for base in range(n):
        words = [word() for _ in range(rng.randint(30, 200))]
        for copy in range(rng.randint(1, 5)):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = word()
            if copy == 3:
                half = len(own) // 2
                own = own[half:] + own[:half]
            rows.append((base * 10 + copy, " ".join(own)))
    return rows + [(9990, None), (9991, ""), (9992, "short " * 10), (9993, rows[0][1] + "​"), rows[0]]


@pytest.mark.parametrize("shard", [4096, 3])
def test_similar_pairs_equal_brute_force(spark, shard, monkeypatch):
    rows = variants(60, 3)
    chunks = spark.createDataFrame([(i, 1, None, t, 1, "f") for i, t in rows], CHUNKS)
    results = spark.createDataFrame([(rows[0][0], "e", rows[0][1], None, None, "x")], RESULTS)
    original = neardup.candidates
    monkeypatch.setattr(neardup, "candidates", lambda classes, stages: original(classes, stages, shard=shard))
    got = {tuple(r) for r in neardup.similar_pairs(chunks, results).collect()}
    want = brute(dict(rows).items())
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 100
    groups = {r.id: r for r in neardup.similar_groups(chunks, results).collect()}
    assert set(groups) == {i for _, *pair in got for i in pair}
    assert all(groups[a].group == groups[b].group for _, a, b in got)
    assert groups[rows[0][0]].rep == groups[9993].rep == rows[0][0]


def test_similar_pairs_of_nothing(spark):
    chunks, results = spark.createDataFrame([], CHUNKS), spark.createDataFrame([], RESULTS)
    assert neardup.similar_pairs(chunks, results).count() == 0 and neardup.similar_groups(chunks, results).count() == 0


def test_copies_are_all_in_pairs(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, text) for i in range(60)] + [(100 + i, text + " end") for i in range(3)]
    chunks = spark.createDataFrame([(i, 1, None, t, 1, "f") for i, t in rows], CHUNKS)
    got = [tuple(r)[1:] for r in neardup.similar_pairs(chunks, spark.createDataFrame([], RESULTS)).collect()]
    ids = [i for i, _ in rows]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in ids for b in ids if a < b}


def test_trees_of_real_sketches_are_mostly_not_visited(spark, small):
    """The share of a tree's nodes that a search sees, over the short sketches of 2,500 real texts."""
    folder = small.replace("0.001", "0.01")
    texts = lookalike.texts_of(spark.read.parquet(f"{folder}/chunks.parquet"), spark.read.parquet(f"{folder}/conversion_results.parquet"))
    rows = neardup.sketches(texts, {}).select("id", "short").limit(2500).collect()
    for table in (0, 17, neardup.TABLES - 1):
        tree = neardup.BKTree()
        short = [r.short[table] for r in rows]
        for i, x in enumerate(short):
            tree.add(x, i)
        seen = []
        for x in short[::10]:
            tree.within(x, neardup.RADIUS)
            seen.append(tree.visited / len(set(short)))
        assert np.mean(seen) < 0.2


@pytest.mark.parametrize("low, high, least", [(0.6, 0.65, 0.97), (0.65, 0.8, 0.99)])
def test_recall_by_similarity(spark, low, high, least):
    """Pairs of made texts of known similarity that the trees find, of all."""
    rng = random.Random(7)
    texts, n = [], 0
    while n < 600:
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(60)]
        other = [w if rng.random() > 0.16 * rng.random() else "".join(rng.choice("klmnop") for _ in w) for w in words]
        a, b = ("".join(x) for x in (words, other))
        sets = [{x[k : k + 5] for k in range(len(x) - 4)} for x in (a, b)]
        if low <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < high:
            texts += [(2 * n, a), (2 * n + 1, b)]
            n += 1
    chunks = spark.createDataFrame([(i, 1, None, t, 1, "f") for i, t in texts], CHUNKS)
    assert neardup.similar_pairs(chunks, spark.createDataFrame([], RESULTS)).count() >= least * n


def test_tree_finds_all_within_the_radius():
    rng = random.Random(4)
    base = [rng.getrandbits(256) for _ in range(20)]
    items = [b ^ sum(1 << rng.randrange(256) for _ in range(rng.randint(0, 90))) for b in base for _ in range(6)]
    tree = neardup.BKTree()
    for i, x in enumerate(items):
        assert sorted(tree.within(x, 74)) == [j for j in range(i) if (items[j] ^ x).bit_count() <= 74]
        tree.add(x, i)


# --- 2: encodings


@pytest.fixture(scope="module")
def model(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").filter("text is not null and doc_id % 4 > 0").collect()]
    return mojibake.Model.train(texts)


def test_held_out_sentences_come_back(model, spark, small):
    held = [s for r in spark.read.parquet(f"{small}/documents.parquet").filter("text is not null and doc_id % 4 = 0").collect() for s in mojibake.sentences(r.text)]
    held = [s for s in held if sum(ord(c) > 127 for c in s) > 4 and 25 < len(s) < 300][:120]
    exact = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("gb18030", "latin-1"), ("gb18030", "cp1251"), ("utf-8", "cp437")]
    n = found = restored = 0
    for i, s in enumerate(held):
        broken = mojibake.garble(s, [exact[i % len(exact)]])
        if broken and broken != s:
            n += 1
            got, text, _ = model.repair(broken)
            found += got
            restored += text == s
    assert n > 50 and found >= 0.95 * n and restored >= 0.9 * n
    lost = [mojibake.garble(s, [("utf-8", "gb18030")]) for s in held] + [mojibake.garble(s, [("gb18030", "utf-8")]) for s in held]
    assert np.mean([model.repair(x)[0] for x in lost if "�" in x]) > 0.95
    assert np.mean([model.repair(s)[0] for s in held]) < 0.02


def test_right_texts_stay(model):
    for t in ["Приложение № 4 к договору", "Ærøvig Nørgårdsen, Łucja Żółcik, Çağrı Öztel", "Âge : 9 ans ; Ô combien", "Điều khoản số 9", "價款總額及違約責任另議，繁體副本存檔", "§ 9 Abs. 9, ¶ 9, © 9, ½ Anteil", "※ 备注：㎡、№、→、★", "— 2 —", "· 7 ·", "Παράρτημα Β, σελίδα ιδ", "", "  \n", "plain"]:
        assert not model.repair(t)[0], t


def test_repair_table(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    good = "Die Beklagte wendet ein, sie habe es versäumt, die Prüfmuster zu übergeben."
    bad = good.encode().decode("latin-1")
    rows = [(1, "e", good, None, None, ""), (2, "e", bad, None, None, ""), (2, "e", bad, None, None, ""), (3, "e", None, None, None, ""), (4, "e", "", None, None, ""), (5, "e", "  \n", None, None, "")]
    results = spark.createDataFrame(rows, RESULTS)
    got = mojibake.repair(results, documents).collect()
    assert [(r.result_id, r.restored) for r in got] == [(2, good)]
    assert mojibake.repair(results.limit(0), documents.limit(0)).count() == 0


# --- 4: scans

SCAN = """（2026）松浦民初2724号判决
扣除已付的人民币3,008元后，溪岭鸿序仓储合伙企业（有
限合伙）尚应向秦泽润支付人民币4,519元。

The claimant asks that the company inspect the maint-
— 1 —
（2026）松浦民初2724号判决
enance log within ten working days, and the parties

数量
250
3
41
— 2 —
signed the agreement t0 pay. The end of the text is here."""


EMPTY = lattice.Model(np.zeros(lattice.SIZE, np.int64))


@pytest.fixture(scope="module")
def language():
    """A model of a small text of its own."""
    lines = [
        "the parties agree that the agreement was signed in the presence of both witnesses", "the agreement was signed by the tenant and the landlord in the morning", "the company shall inspect the maintenance log within ten working days",
        "the court notes that the document was filed in time and that no objection was raised", "双方已经确认货款已经付清", "合同双方已经签署补充协议并已经履行", "公司已经支付全部货款",
    ] * 20
    counts = lattice.Counts()
    counts.text(lines)
    counts.flush()
    return lattice.Model(counts.all)


def test_counts_are_the_same_in_any_order():
    lines = ["(a): one", "two : three", "four : five", "双方：已经", "六 ： 七"]
    both = []
    for given in (lines, lines[::-1]):
        counts = lattice.Counts()
        counts.text(given)
        counts.flush()
        both.append(counts.part["words"].copy())
    assert both[0][lattice.word_slots(":")[0]] == 3 and both[0][lattice.word_slots("：")[0]] == 2 and (both[0] == both[1]).all()


def test_page_furniture_and_paragraphs():
    page = scans.Page(SCAN, None, None, EMPTY)
    assert {page.lines[i] for i in page.headers} == {"（2026）松浦民初2724号判决"} and {page.lines[i] for i in page.numbers} == {"— 1 —", "— 2 —"}
    text = scans.paragraphs(page)
    assert "maintenance log within ten" in text and "合伙企业（有限合伙）尚应" in text and "— 1 —" not in text and "民初" not in text
    assert scans.Page("a plain text\nwithout anything", None, None, EMPTY).headers == set()


@pytest.mark.parametrize("header", ["Minutes of the harbour board, second sitting", "ARKIVEKSEMPLAR TIL RETTEN", "甲乙丙调解笔录摘编", "Akt V/17 - odpis", "Copia para el fiscal del distrito"])
def test_headers_of_any_kind_at_the_top_of_pages(header):
    pages = [("The panel heard the first witness at length on the second day and then", "turned to the ledger, which both sides had brought along and"), ("which the clerk had copied out by hand before the sitting so that", "nobody could say any longer which of the entries was the older"), ("one, a point on which counsel for the owners laid great weight when", "the board came to the question of the berth and")]
    text = "".join(f"{header}\n{a}\n{b}\n- {k} -\n" for k, (a, b) in enumerate(pages, 1)) + "closed the hearing."
    page = scans.Page(text, None, None, EMPTY)
    assert {page.lines[i] for i in page.headers} == {header} and len(page.numbers) == 3
    assert header not in scans.paragraphs(page) and all(x in scans.paragraphs(page) for pair in pages for x in pair)


@pytest.mark.parametrize(
    "lines",
    [["Instalment of 3000 euro on the account", "Instalment of 8000 euro on the account", "Instalment of 5000 euro on the account"], ["1. 支付租金人民币3000元", "2. 支付租金人民币8000元"], ["数量", "250", "3", "41"], ["Paid in full, room 3", "Paid in full, room 4"]],
)
def test_lines_that_differ_in_digits_are_content(lines):
    text = "The tenant owes the landlord these sums.\n" + "\n".join(lines) + "\nThe claim is allowed."
    for given in (text, text.replace("\n", "\n\n")):
        page = scans.Page(given, None, None, EMPTY)
        assert not page.headers and not page.numbers
        assert all(x in scans.paragraphs(page) for x in lines)


def test_the_lattice_splits_merges_and_joins(language):
    cases = {
        "the agree ment was sig ned by the tenant": "the agreement was signed by the tenant", "the agreementwas signed by the tenant": "the agreement was signed by the tenant", "the agreement was sign-\ned by the tenant": "the agreement was signed by the tenant",
        "the agree\nment was signed by the tenant": "the agreement was signed by the tenant", "the agreemcnt was signed by the tenant": "the agreement was signed by the tenant", "the docurn-\nent was filed in time": "the document was filed in time", "the agreement was\nsigned by the tenant": "the agreement was signed by the tenant",
    }
    for given, wanted in cases.items():
        n = given.count("\n") + 1
        assert scans.paragraphs(scans.Page(given, [0.7] * n, None, language)) == wanted, given
    path, _ = lattice.decode([lattice.tokens(x) for x in "the docurn-\nent was filed".split("\n")], [4.0, 4.0], language)
    assert [(what[0], what[-1]) for what in path] == [("hyphen", "document")]
    assert scans.defects(scans.Page("双方己经确认货款已经付清", [0.7], None, language)) == ["misread"] and scans.paragraphs(scans.Page("双方己经确认货款已经付清", [0.7], None, language)) == "双方已经确认货款已经付清"
    assert scans.defects(scans.Page("双方已经确认货款已经付清", [0.99], None, language)) == []
    # the second reading decides, and where it is silent the count of mismatched numbers does
    assert scans.defects(scans.Page("the sum of 381 was filed", [0.7], "the sum of 881 was filed", language)) == ["misread"]
    assert scans.defects(scans.Page("the sum of 381 was filed", [0.3], "the sum of 381 was filed", language)) == []


@pytest.mark.parametrize("confidence", [None, 0.99])
def test_known_words_cost_little(language, confidence):
    """Calls are counted, not seconds, which depend on the machine."""
    lines = [f"{k} {x}" for k in range(20) for x in ("the parties agree that the agreement was signed in the presence of both witnesses", "the court notes that the document was filed in time and that no objection was raised", "合同双方已经签署补充协议并已经履行")]
    given = "\n".join(lines), [confidence] * len(lines) if confidence else None, None, language
    scans.defects(scans.Page(*given))
    profile = cProfile.Profile()
    profile.runcall(lambda: scans.defects(scans.Page(*given)))
    assert sum(x.callcount for x in profile.getstats()) < 15 * sum(len(lattice.tokens(x)) for x in lines)


def test_a_line_that_most_lines_do_not_exceed():
    rng = np.random.default_rng(4)
    for n in [*range(1, 40), 900]:
        lines = ["x" * k for k in rng.integers(0, 120, n).tolist()]
        assert scans.width_of(lines) == float(np.percentile([len(x) for x in lines], 80))


def test_a_paragraph_of_very_many_lines():
    text = "\n".join("the witness went on to say that the goods which had been" for _ in range(900)) + " sent."
    assert scans.paragraphs(scans.Page(text, None, None, EMPTY)).count("\n\n") == 0


def test_defects_table(spark):
    clean = "The parties signed the agreement to pay.\nThe end of the text is here.\n"
    n = len([x for x in SCAN.split("\n") if x.strip()])
    sure = [0.95] * (n - 1) + [0.4]
    rows = [
        (1, "local:a", SCAN, sure, None, ""), (1, "local:a", SCAN, sure, None, ""), (2, "cloud:b", clean, [0.7, 0.95], None, ""), (3, "native", SCAN, None, None, ""), (4, "local:a", None, None, None, ""), (5, "local:a", "", [], None, ""),
        (6, "local:a", clean, [0.9], None, ""), (7, "local:a", "x" * 100000, [0.95], None, ""), (8, None, clean, None, None, ""), (9, "local:a", clean.replace("pay", "pav"), [0.5, 0.95], None, ""),
    ]
    results = spark.createDataFrame(rows, RESULTS)
    checks = spark.createDataFrame([(1, SCAN.replace("t0", "to"), 0, ""), (2, clean, 0, "x"), (2, clean, 0, "x"), (9, clean, 0, None), (77, "x", None, None)], "result_id bigint, second_text string, digit_mismatches int, text string")
    got = sorted(tuple(r) for r in scans.find_defects(results, checks).collect())
    assert got == [(1, "hyphenation"), (1, "misread"), (1, "page_number"), (1, "running_header"), (9, "misread")]
    repaired = {r.result_id: r.repaired for r in scans.repair(results, checks).collect()}
    assert set(repaired) == {1, 2, 6, 7, 9} and "to pay" in repaired[9]
    assert scans.find_defects(results.limit(0), checks.limit(0)).count() == 0


# --- 7: packing


def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, "word " * rng.randint(1, 400), "x") for i in range(300)] + [(900, "合同 " * 3000, "y"), (901, None, ""), (902, "", ""), (0, "again", "z"), (903, " a" * 512, "")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, container string")
    counts = {}
    for i, t, _ in rows:
        counts.setdefault(i, []).append(int(bpe.Encoder.of().counts([t])[0]))
    for items in (4000, 40):
        got = packing.pack(documents, 512, items=items).toPandas()
        assert (got.groupby("container").n_tokens.sum() <= 512).all()
        assert sorted(got.container.unique()) == list(range(got.container.nunique()))
        sizes = got.groupby("doc_id").n_tokens.sum()
        assert set(sizes.index) == {i for i, c in counts.items() if c[0]} and all(sizes[i] in counts[i] for i in sizes.index)
        assert not got.duplicated(["doc_id", "part"]).any() and got[got.doc_id != 900].groupby("doc_id").size().max() == 1
        least = -(-got.n_tokens.sum() // 512)
        assert got.container.nunique() <= least * 1.03 + 1
    assert packing.pack(documents.limit(0), 512).count() == 0


def test_local_search_beats_best_fit():
    rng = np.random.default_rng(6)
    for low, high, n in ((200, 500, 600), (250, 600, 800)):
        sizes = rng.integers(low, high, n)
        one, two = (packing.fill_bins(sizes, 1000, search) for search in (False, True))
        assert two.max() < one.max()
        fills = [np.bincount(of, sizes) for of in (one, two)]
        assert (fills[1] ** 2).sum() > (fills[0] ** 2).sum() and fills[1].max() <= 1000
    hard = np.array([502] * 6 + [254] * 6 + [252] * 6 + [246] * 12)  # best fit needs 11 containers, 9 are enough
    assert packing.fill_bins(hard, 1000, False).max() == 10 and packing.fill_bins(hard, 1000).max() == 8


def test_items_of_one_size_and_of_more_than_half():
    """Very many items of one size, and items of which no two go together, end without a search through all of them."""
    assert packing.fill_bins(np.full(4000, 300), 1000).max() == 1333
    assert packing.fill_bins(np.full(4000, 501), 1000).max() == 3999


def test_items_that_never_go_together_stay_in_their_neighbourhoods(spark):
    documents = spark.range(600).selectExpr("id as doc_id", "repeat(' a', 300) as text")
    got = packing.pack(documents, 512, items=50).toPandas()
    assert sorted(got.container) == list(range(600)) and (got.n_tokens == 300).all()


# --- registration


def test_queries_run_on_the_smallest_tables(spark, small):
    columns = {"p1_found": ["chunk_id"], "p2_found": ["result_id"], "p3_found": ["tbl", "id_a", "id_b"], "p4_found": ["result_id", "defect"], "p5_found": ["tbl", "id_a", "id_b"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}
    made = {name: run(spark, small) for name, run in queries.queries().items() if name in columns}
    assert {n: d.columns for n, d in made.items()} == columns
    assert all(d.count() > 0 for d in made.values())
