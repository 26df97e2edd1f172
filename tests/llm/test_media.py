import numpy as np

from pathlight.llm import media

VECTORS = "vec_id long, embedding array<float>, label int"
KINDS = list(media.EDITS)


def vectors(n=96):
    rng = np.random.default_rng(4)
    return [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(n)]


def words(image):
    place, code = media.describe(image)
    return place, np.ascontiguousarray(code).view(np.uint64)


def test_pictures_survive_packing():
    p = media.draw(3)
    assert (media.unpack(media.pack(p)) == p).all()
    for bad in (None, b"", b"\x01", media.pack(p)[:-1]):
        assert media.unpack(bad) is None


def test_descriptors_turn_with_the_picture():
    p = media.draw(5)
    a, b = (media.describe(x)[1] for x in (p, np.rot90(p).copy()))
    apart = np.unpackbits(a[:, None] ^ b[None], axis=2).sum(2).min(1)
    assert len(a) > 20 and (apart <= 10).mean() > 0.8
    assert len(media.describe(np.full((90, 90), 7, np.uint8))[1]) == 0 and len(media.describe(np.zeros((3, 3), np.uint8))[1]) == 0


def test_a_stack_is_described_as_its_images_are():
    images = np.stack([media.draw(k) for k in range(5)])
    b, place, code = media.described_stack(images, media.pattern())
    for k, image in enumerate(images):
        one = media.describe(image)
        assert np.allclose(place[b == k], one[0]) and (code[b == k] == one[1]).all()


def test_places_survive_packing():
    place, _ = media.describe(media.draw(9))
    back = media.unpacked_places(media.packed_places(place))
    assert np.abs(back[:, :2] - place[:, :2]).max() < 1e-4 and np.abs(np.angle(np.exp(1j * (back[:, 2] - place[:, 2])))).max() < 0.02 and np.allclose(back[:, 3], place[:, 3])


def meetings(images):
    """Brute force: corners of different images whose keys are equal, as (a, b, i, j), with a below b."""
    out = set()
    keys = [[media.table_keys(media.describe(x)[1], t) for t in range(media.TABLES)] for x in images]
    for b in range(len(images)):
        for a in range(b):
            for t in range(media.TABLES):
                out |= {(a, b, int(i), int(j)) for i, j in zip(*np.nonzero(keys[a][t][:, None] == keys[b][t][None]), strict=True)}
    return out


def test_meetings_against_brute_force(spark, monkeypatch):
    images = [f for k in range(6) for f in (media.draw(k), media.edited(media.draw(k), k), media.draw(k))]
    raw = [media.described_stack(x[None], media.pattern()) for x in images]
    rows = [(k, len(c), bytearray(media.packed_places(p)), bytearray(c.tobytes())) for k, (_, p, c) in enumerate(raw)]
    pics = spark.createDataFrame(rows, "pic long, n_corners long, places binary, codes binary").repartition(3)
    met = media.met(media.keys(pics, 0))
    for t in range(1, media.TABLES):
        met = met.unionByName(media.met(media.keys(pics, t)))
    want = meetings(images)
    assert {(r.a, r.b, r.i & media.NUMBER, r.j & media.NUMBER) for r in met.collect()} == want and met.filter("key IS NOT NULL").isEmpty()
    # large keys: every image of a key is named beside the key's first one
    monkeypatch.setattr(media, "FEW", 2)
    large = media.met(media.keys(pics, 0)).filter("key IS NOT NULL").collect()
    own = {}
    for k, (_, _, c) in enumerate(raw):
        for v in media.table_keys(c, 0).tolist():
            own.setdefault(v, []).append(k)
    assert sorted((r.key, r.b) for r in large) == sorted((v, k) for v, ks in own.items() if len(ks) > 2 for k in ks)
    assert all(r.a == min(own[r.key]) for r in large)


def test_meetings_that_agree():
    corner = lambda n, angle, level: n + (angle % 256 << 32) + (level + 128 << 40)
    i = np.array([corner(3, 10, 0), corner(4, 200, 2)])
    assert media.agree(i, np.array([corner(9, 60, 1), corner(8, 250, 3)]))
    assert media.agree(i, np.array([corner(9, 60, 1), corner(8, 260, 3)]))
    assert not media.agree(i, np.array([corner(9, 60, 1), corner(8, 130, 3)]))
    assert not media.agree(i, np.array([corner(9, 60, 1), corner(8, 250, 8)]))
    assert not media.agree(i, np.array([corner(9, 60, 1), corner(9, 250, 3)]))
    assert not media.agree(i[:1], i[:1])


def plainly_agree(i, j):
    """Whether two meetings of different corners agree, pair by pair."""
    turn, scale = (j >> 32) - (i >> 32) & 255, (j >> 40) - (i >> 40)
    for x in range(len(i)):
        for y in range(x):
            apart = int(turn[x] - turn[y]) & 255
            differ = all(int(c[x]) & media.NUMBER != int(c[y]) & media.NUMBER for c in (i, j))
            if differ and min(apart, 256 - apart) <= media.TURN_STEPS and abs(scale[x] - scale[y]) <= media.LEVELS:
                return True
    return False


def test_meetings_of_many_pairs_at_once():
    rng = np.random.default_rng(2)
    n = rng.integers(0, 5, 400)
    row = np.repeat(np.arange(400), n)
    i, j = (rng.integers(0, 4, len(row)) + (rng.integers(0, 256, len(row)) << 32) + (rng.integers(120, 130, len(row)) << 40) for _ in range(2))
    got = media.agreeing(row, i, j, 400)
    assert got.tolist() == [plainly_agree(i[row == r], j[row == r]) for r in range(400)] and 20 < got.sum() < 380
    # corners of a pair's images meet where they share a key; pairs that meet very often are only counted
    keys = [[np.sort(rng.integers(0, 6, k)) for k in rng.integers(0, 9, 50)] for _ in range(2)]
    keys[0][7] = keys[1][7] = np.zeros(media.MANY, np.int64)
    rows = tuple(np.repeat(np.arange(50), [len(k) for k in side]) for side in keys)
    flat = tuple(np.concatenate(side) for side in keys)
    total = np.zeros(50, np.int64)
    found = media.shared_corners(rows, flat, tuple(np.arange(len(k)) for k in flat), total)
    want = [(r, x, y) for x, r in enumerate(rows[0]) for y, s in enumerate(rows[1]) if r == s and flat[0][x] == flat[1][y]]
    assert np.bincount([r for r, _, _ in want], minlength=50).tolist() == total.tolist() and total[7] == media.MANY**2
    assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted((int(r), x, y) for r, x, y in want if r != 7)


def test_nearest_descriptors_against_all_bits():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (150, 32), np.uint8), rng.integers(0, 256, (90, 32), np.uint8)
    b[:40] = a[:40] ^ (1 << rng.integers(0, 8, (40, 32)) * (rng.random((40, 32)) < 0.5)).astype(np.uint8)
    b[50] = ~a[50]
    apart = np.unpackbits(a[:, None] ^ b[None], axis=2).sum(2)
    near, best = media.nearest((a.view(np.uint64), b.view(np.uint64)))
    assert near.tolist() == apart.argmin(1).tolist() and best.tolist() == apart.min(1).tolist()
    opposite = media.nearest((a[:1].view(np.uint64), (~a[:1]).view(np.uint64)))
    assert opposite[0].tolist() == [0] and opposite[1][0] > media.MOST_BITS
    assert len(media.nearest((a.view(np.uint64), b[:0].view(np.uint64)))[0]) == 0 == len(media.nearest((a[:0].view(np.uint64), b.view(np.uint64)))[0])


def test_consensus_wants_one_scale_turn_and_shift():
    place, code = words(media.draw(11))
    rng = np.random.default_rng(0)
    z = (place[:, 0] + 1j * place[:, 1]) * 1.4 * np.exp(0.5j) + 30
    moved = np.column_stack([z.real, z.imag, place[:, 2] + 0.5, place[:, 3] * 1.4])
    spread = moved.copy()
    spread[:, :2] = rng.uniform(0, 96, (len(place), 2))
    # levels that see one place vote once
    assert media.agreed((place, moved), (code, code)) >= 0.4 * len(place)
    assert media.agreed((place, spread), (code, code)) < media.LEAST_VOTES
    assert media.agreed((place[:3], moved[:3]), (code[:3], code[:3])) == 0


def test_recall_by_kind_and_no_false_links():
    base = [media.draw(k) for k in range(20)]
    own = [words(x) for x in base]
    for kind, edit in media.EDITS.items():
        found = 0
        for x, (place, code) in zip(base, own, strict=True):
            q, c = words(np.ascontiguousarray(edit(x)))
            met = [np.nonzero(media.table_keys(code.view(np.uint8), t)[:, None] == media.table_keys(c.view(np.uint8), t)[None]) for t in range(media.TABLES)]
            two = all(len({int(v) for m in met for v in m[side]}) > 1 for side in (0, 1))
            found += two and media.agreed((place, q), (code, c)) >= media.LEAST_VOTES
        assert found >= 0.9 * len(base), kind
    assert max(media.agreed((own[a][0], own[b][0]), (own[a][1], own[b][1])) for a in range(20) for b in range(a)) < media.LEAST_VOTES


def test_groups(spark):
    data = vectors()
    data += [(1000, data[0][1], 1), (1001, data[0][1], 1), (None, data[1][1], 0), (1002, None, None), (1003, None, None), (1003, None, None)]
    docs = spark.createDataFrame(data, VECTORS).withColumnRenamed("label", "pic")
    rows = {}
    out = media.groups(media.pictures(docs)).collect()
    assert len(out) == len(data)
    for r in out:
        rows.setdefault(r.id, r)
    for i in range(96):
        want = i - 1 if i % media.EVERY == media.EVERY - 3 else i
        assert rows[i].group_id == want, (i, rows[i])
    assert rows[1000].group_id == rows[1001].group_id == 0 and rows[None].group_id == 1
    assert rows[1002].group_id == 1002 and rows[1003].group_id == 1003 and rows[1002].n_corners == 0


def test_groups_do_not_depend_on_large_keys(spark, monkeypatch):
    docs = spark.createDataFrame(vectors(40), VECTORS)
    few = {r.id: r.group_id for r in media.groups(media.pictures(docs)).collect()}
    monkeypatch.setattr(media, "FEW", 1)
    assert {r.id: r.group_id for r in media.groups(media.pictures(docs)).collect()} == few


def test_copies_of_no_images(spark):
    assert media.groups(media.pictures(spark.createDataFrame([], VECTORS))).count() == 0
    flat = bytearray(media.pack(np.full((80, 80), 9, np.uint8)))
    docs = spark.createDataFrame([(1, flat, "x"), (2, flat, "x"), (3, bytearray(b"zz"), "x"), (None, None, "x")], "id long, image binary, digest string")
    got = sorted(((r.id or 0), r.group_id, r.n_corners) for r in media.groups(docs).collect())
    assert got == [(0, None, 0), (1, 1, 0), (2, 1, 0), (3, 3, 0)]


def test_candidates_do_not_depend_on_large_keys(spark, monkeypatch):
    """Pairs that meet once by a large key and once by a small one, twice by large keys, or twice by one."""
    images = [media.draw(k) for k in range(4)]
    images += [media.edited(images[k % 4], k) for k in range(12)]
    raw = [media.described_stack(x[None], media.pattern()) for x in images]
    rows = [(k, len(c), bytearray(media.packed_places(p)), bytearray(c.tobytes())) for k, (_, p, c) in enumerate(raw)]
    pics = spark.createDataFrame(rows, "pic long, n_corners long, places binary, codes binary").repartition(3).persist()
    met = {}
    number = [media.unpacked_places(media.packed_places(p)) for _, p, _ in raw]
    turned = [(np.round(p[:, 2] * 128 / np.pi).astype(np.int64) & 255) for p in number]
    level = [np.round(np.log2(p[:, 3]) * media.PER_OCTAVE).astype(np.int64) + 128 for p in number]
    for a, b, i, j in meetings(images):
        met.setdefault((a, b), []).append((i + (int(turned[a][i]) << 32) + (int(level[a][i]) << 40), j + (int(turned[b][j]) << 32) + (int(level[b][j]) << 40)))
    for pair in list(met):
        i, j = (np.array(x) for x in zip(*met[pair], strict=True))
        if not media.agree(i, j):
            del met[pair]
    place, code = zip(*[(media.unpacked_places(media.packed_places(p)), c.view(np.uint64)) for _, p, c in raw], strict=True)
    want = {(a, b) for a, b in met if media.agreed((place[a], place[b]), (code[a], code[b])) >= media.LEAST_VOTES}
    assert len(want) > 20
    for few in (32, 2, 1):
        monkeypatch.setattr(media, "FEW", few)
        found = media.links(pics).collect()
        assert len(found) == len(want) and {(r.a, r.b) for r in found} == want, few


def test_links_of_many_near_copies(spark):
    images = [(media.draw(3) * 0.7).astype(np.uint8) + np.uint8(k) for k in range(media.FEW + 6)]
    docs = spark.createDataFrame([(k, bytearray(media.pack(x))) for k, x in enumerate(images)], "id long, image binary")
    assert {(r.id, r.n_links, r.group_id) for r in media.groups(docs).collect()} == {(k, len(images) - 1, 0) for k in range(len(images))}
