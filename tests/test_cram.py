"""CRAM files made by a small encoder, against the rows that they were made of."""

import bz2
import lzma
import random
import struct
import zlib

import pytest

from strandwise.sources import alignments, cram, rans

CONTIGS = ["chr1", "chr2"]
HEAD = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:5000\n@SQ\tSN:chr2\tLN:5000\n@RG\tID:g0\tSM:s\n@RG\tID:g1\tSM:s\n"
GENOME = {c: "".join(random.Random(i).choice("ACGT") for _ in range(5000)) for i, c in enumerate(CONTIGS)}
ORDER = {b: [x for x in "ACGTN" if x != b] for b in "ACGTN"}


def itf8(n):
    n &= 0xFFFFFFFF
    for more, top in ((0, 0x00), (1, 0x80), (2, 0xC0), (3, 0xE0)):
        if n < 1 << 7 * (more + 1):
            return bytes([top | n >> 8 * more]) + (n & (1 << 8 * more) - 1).to_bytes(more, "big")
    return bytes([0xF0 | n >> 28, n >> 20 & 255, n >> 12 & 255, n >> 4 & 255, n & 15])


def ltf8(n):
    for more in range(8):
        if n < 1 << 7 * (more + 1):
            top = 0xFF00 >> more & 0xFF
            return bytes([top | n >> 8 * more]) + (n & (1 << 8 * more) - 1).to_bytes(more, "big")
    return b"\xff" + n.to_bytes(8, "big")


def test_numbers():
    for n in [0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**31 - 1, -1, -2, -(2**31)]:
        assert cram.Source(itf8(n)).itf8() == n
    for n in [0, 127, 128, 2**35, 2**48 + 7, 2**55, 2**56 - 1, 2**62]:
        assert cram.Source(ltf8(n)).ltf8() == n


def table(counts, put):
    """Frequencies to a sum of 4096, written by ``put`` with the symbols' runs; returns frequency and start of each."""
    total = sum(counts.values())
    freq = {s: max(1, c * 4096 // total) for s, c in counts.items()}
    freq[max(freq, key=freq.get)] += 4096 - sum(freq.values())
    start, at = {}, 0
    for s in sorted(freq):
        start[s], at = at, at + freq[s]
    symbols(sorted(freq), put, lambda s: put(*([freq[s]] if freq[s] < 128 else [0x80 | freq[s] >> 8, freq[s] & 255])))
    return freq, start


def symbols(listed, put, body):
    run = 0
    for i, s in enumerate(listed):
        if run:
            run -= 1
        else:
            put(s)
            if i and listed[i - 1] == s - 1:
                while i + run + 1 < len(listed) and listed[i + run + 1] == s + run + 1:
                    run += 1
                put(run)
        body(s)
    put(0)


def rans_encode(data, order):
    head, quarter = bytearray(), len(data) // 4
    put = lambda *b: head.extend(b)
    if order == 0:
        counts = {s: data.count(bytes([s])) for s in set(data)}
        made = table(counts, put)
        steps = [(i % 4, data[i], made) for i in range(len(data))]
    else:
        places = [(k, k * quarter + i) for i in range(quarter) for k in range(4)] + [(3, i) for i in range(4 * quarter, len(data))]
        context = {i: (0 if i == k * quarter else data[i - 1]) for k, i in places}
        counts = {}
        for _, i in places:
            counts.setdefault(context[i], {}).setdefault(data[i], 0)
            counts[context[i]][data[i]] += 1
        tables = {}
        symbols(sorted(counts), put, lambda c: tables.__setitem__(c, table(counts[c], put)))
        steps = [(k, data[i], tables[context[i]]) for k, i in places]
    states, out = [rans.LOW] * 4, bytearray()
    for k, s, (freq, start) in reversed(steps):
        while states[k] >= (rans.LOW >> 12 << 8) * freq[s]:
            out.append(states[k] & 255)
            states[k] >>= 8
        states[k] = (states[k] // freq[s] << 12) + states[k] % freq[s] + start[s]
    body = bytes(head) + struct.pack("<4I", *states) + bytes(reversed(out))
    return struct.pack("<BII", order, len(body), len(data)) + body


@pytest.mark.parametrize("order", [0, 1])
def test_rans(order):
    draw = random.Random(order)
    for data in (b"a", b"aaaa" * 50, bytes(range(256)) * 3, bytes(draw.choice(b"ACGTN") for _ in range(1001)), bytes(draw.choices(range(40), range(1, 41), k=777)), bytes([0, 1, 2, 3, 7, 8]) * 9):
        assert rans.decode(rans_encode(data, order)) == data


METHODS = {"raw": (0, bytes), "gzip": (1, lambda d: zlib.compressobj(6, zlib.DEFLATED, 31)), "bz2": (2, bz2.compress), "lzma": (3, lzma.compress), "rans0": (4, lambda d: rans_encode(d, 0)), "rans1": (4, lambda d: rans_encode(d, 1))}


def block(kind, number, data, method="raw"):
    code, pack = METHODS[method if len(data) > 3 else "raw"]
    if code == 1:
        made = pack(data)
        body = made.compress(data) + made.flush()
    else:
        body = pack(data)
    return bytes([code, kind]) + itf8(number) + itf8(len(body)) + itf8(len(data)) + body + b"\0" * 4


def container(blocks, ref, n_records, counter, landmarks):
    data = b"".join(blocks)
    return struct.pack("<i", len(data)) + itf8(ref) + itf8(1) + itf8(0) + itf8(n_records) + ltf8(counter) + ltf8(0) + itf8(len(blocks)) + itf8(len(landmarks)) + b"".join(map(itf8, landmarks)) + b"\0" * 4 + data


def code(kind, *params):
    body = b"".join(p if isinstance(p, bytes) else itf8(p) for p in params)
    return itf8(kind) + itf8(len(body)) + body


class Encoder:
    """A slice for each list of reads (dicts); numbers stand in blocks of their own, but for three series in the core block."""

    SERIES = ["BF", "RI", "RL", "AP", "RG", "MF", "NS", "NP", "TS", "NF", "TL", "FN", "FP", "DL", "RS", "PD", "HC", "FC", "BS", "BA", "QS"]

    def __init__(self, methods, names=True, delta=True, embedded=True):
        self.methods, self.names, self.delta, self.embedded = methods, names, delta, embedded
        self.ids = {k: i + 1 for i, k in enumerate([*self.SERIES, "RN", "IN", "SC", "SCn", "BB", "BBn", "QQ", "QQn", "tag", "tagn", "ref"])}

    def rules(self, lines):
        outer = lambda k: code(1, self.ids[k])
        series = {k: outer(k) for k in self.SERIES}
        series |= {"CF": code(3, 6, 1, 2, 3, 4, 5, 9, 6, 2, 2, 2, 3, 4, 4), "MQ": code(6, 3, 9), "RN": code(5, b"\0", self.ids["RN"]), "IN": code(5, b"\0", self.ids["IN"])}
        series |= {k: code(4, outer(k + "n"), outer(k)) for k in ("SC", "BB", "QQ")}
        series["FN"] = code(9, 1)
        series["HC"] = code(7, 0, 2)
        tags = {t: code(4, outer("tagn"), outer("tag")) for line in lines for t in line}
        kept = {b"RN": bytes([self.names]), b"AP": bytes([self.delta]), b"RR": bytes([self.embedded]), b"SM": bytes([0b00011011] * 5)}
        td = b"".join(b"".join(line) + b"\0" for line in lines)
        kept[b"TD"] = itf8(len(td)) + td
        part = lambda entries: itf8(len(entries) and len(b"".join(entries)) + len(itf8(len(entries)))) + itf8(len(entries)) + b"".join(entries)
        return part([k + v for k, v in kept.items()]) + part([k.encode() + v for k, v in series.items()]) + part([itf8(t[0] << 16 | t[1] << 8 | t[2]) + v for t, v in tags.items()])

    def slice(self, reads, counter, lines, ref):
        outer, bits = {k: bytearray() for k in self.ids}, []
        put = lambda k, n: outer[k].extend(itf8(n))

        def bit(value, n):
            bits.extend(value >> n - 1 - i & 1 for i in range(n))

        start = min((r["pos"] for r in reads), default=1) if ref >= 0 else 0
        last = start
        for i, r in enumerate(reads):
            put("BF", r["flag"])
            # canonical codes of the symbols 1, 2, 3, 4, 5, 9 of 2, 2, 2, 3, 4 and 4 bits
            own = r["own"]
            bit({1: 0b00, 2: 0b01, 3: 0b10, 4: 0b110, 5: 0b1110, 9: 0b1111}[own], {1: 2, 2: 2, 3: 2, 4: 3, 5: 4, 9: 4}[own])
            if ref == -2:
                put("RI", r["ref"])
            put("RL", len(r["seq"]) or r["length"])
            put("AP", r["pos"] - last if self.delta else r["pos"])
            last = r["pos"]
            put("RG", r["group"])
            if self.names:
                outer["RN"] += r["name"].encode() + b"\0"
            if own & 2:
                put("MF", r["mf"])
                if not self.names:
                    outer["RN"] += r["name"].encode() + b"\0"
                put("NS", r["mate"])
                put("NP", r["mate_pos"])
                put("TS", r["tlen"])
            elif own & 4:
                put("NF", r["nf"])
            put("TL", lines.index([t for t, _ in r["tags"]]))
            for _, data in r["tags"]:
                put("tagn", len(data))
                outer["tag"] += data
            if r["flag"] & 4:
                if not own & 8:
                    outer["BA"] += r["seq"].encode()
            else:
                features = self.features(r)
                n = len(features) + 1  # gamma
                bit(0, n.bit_length() - 1)
                bit(n, n.bit_length())
                before = 0
                for place, kind, value in features:
                    outer["FC"] += kind.encode()
                    put("FP", place - before)
                    before = place
                    if kind in "DNP":
                        put({"D": "DL", "N": "RS", "P": "PD"}[kind], value)
                    elif kind == "H":
                        n = 0 if value < 4 else value.bit_length() - 2
                        bit((1 << n) - 1 << 1, n + 1)
                        bit(value if not n else value & (1 << n + 1) - 1, 2 if not n else n + 1)
                    elif kind == "X":
                        outer["BS"].append(value)
                    elif kind == "I":
                        outer["IN"] += value.encode() + b"\0"
                    elif kind in "Sb":
                        put({"S": "SCn", "b": "BBn"}[kind], len(value))
                        outer[{"S": "SC", "b": "BB"}[kind]] += value.encode()
                    elif kind == "i":
                        outer["BA"] += value.encode()
                    elif kind == "B":
                        outer["BA"] += value[0].encode()
                        outer["QS"].append(value[1])
                    elif kind == "q":
                        put("QQn", len(value))
                        outer["QQ"] += bytes(value)
                bit(r["mapq"] + 3, 9)
            if own & 1:
                outer["QS"] += bytes(r["qual"])
        core = bytes(int("".join(map(str, bits[i : i + 8])).ljust(8, "0"), 2) for i in range(0, len(bits), 8))
        span = max((r["pos"] + 400 for r in reads), default=0) - start
        if self.embedded and ref >= 0:
            outer["ref"] = GENOME[CONTIGS[ref]][start - 1 : start - 1 + span].encode()
        used = [(k, bytes(v)) for k, v in outer.items() if v]
        made = [block(cram.CORE, 0, core), *(block(cram.EXTERNAL, self.ids[k], v, self.methods[i % len(self.methods)]) for i, (k, v) in enumerate(used))]
        head = itf8(ref) + itf8(start) + itf8(span) + itf8(len(reads)) + ltf8(counter) + itf8(len(made)) + itf8(len(used)) + b"".join(itf8(self.ids[k]) for k, _ in used)
        head += itf8(self.ids["ref"] if outer["ref"] else -1) + b"\0" * 16
        return [block(cram.SLICE_HEADER, 0, head), *made]

    def features(self, r):
        out, at, ref = [], 1, r["pos"]
        for op, n in r["ops"]:
            if op == "M":
                some = r["seq"][at - 1 : at - 1 + n]
                if not self.embedded:
                    out.append((at, "b", some))
                for k, base in enumerate(some if self.embedded else ""):
                    own = GENOME[CONTIGS[r["ref"]]][ref - 1 + k]
                    if base != own:
                        out.append((at + k, "X", ORDER[own].index(base)) if k % 2 == 0 and base in ORDER[own][:4] else (at + k, "B", (base, 9)))
                at, ref = at + n, ref + n
            elif op == "I":
                out.append((at, "i" if n == 1 else "I", r["seq"][at - 1 : at - 1 + n]))
                at += n
            elif op == "S":
                out.append((at, "S", r["seq"][at - 1 : at - 1 + n]))
                at += n
            else:
                out.append((at, op, n))
                ref += n if op in "DN" else 0
        if r.get("some_qual"):
            out.append((1, "q", r["some_qual"]))
        return sorted(out, key=lambda f: f[0])

    def file(self, containers):
        """containers: lists of slices, (ref, reads)."""
        text = HEAD.encode()
        out = b"CRAM\3\0" + b"x".ljust(20, b"\0") + container([block(cram.FILE_HEADER, 0, struct.pack("<i", len(text)) + text, "gzip")], 0, 0, 0, [])
        counter = 0
        for slices in containers:
            lines = [list(x) for x in dict.fromkeys(tuple(t for t, _ in r["tags"]) for _, reads in slices for r in reads)]
            blocks, marks, n = [block(cram.COMPRESSION_HEADER, 0, self.rules(lines))], [], 0
            for ref, reads in slices:
                marks.append(sum(map(len, blocks)))
                blocks += self.slice(reads, counter + n, lines, ref)
                n += len(reads)
            out += container(blocks, slices[0][0], n, counter, marks)
            counter += n
        return out + container([block(cram.COMPRESSION_HEADER, 0, self.rules([]))], -1, 0, counter, [])


def one(draw, n, ref, pos, **more):
    """A read with differences from the genome."""
    kinds = [[("M", 30)], [("S", 4), ("M", 20), ("N", 100), ("M", 10)], [("H", 7), ("M", 12), ("I", 3), ("M", 5), ("D", 6), ("M", 9)], [("M", 8), ("P", 2), ("I", 1), ("M", 11), ("S", 2)]]
    ops, seq, at = draw.choice(kinds), "", pos
    for op, k in ops:
        if op == "M":
            seq += "".join(b if draw.random() > 0.1 else draw.choice("ACGTN") for b in GENOME[CONTIGS[ref]][at - 1 : at - 1 + k])
        elif op in "IS":
            seq += "".join(draw.choice("ACGT") for _ in range(k))
        at += k if op in "MDN" else 0
    r = {"name": f"r{n}", "flag": draw.choice([0, 16]), "ref": ref, "pos": pos, "mapq": draw.choice([0, 3, 60, 255]), "ops": ops, "seq": seq, "qual": [draw.randrange(41) for _ in seq], "length": 0, "own": 3, "group": draw.choice([-1, 0, 1])}
    r |= {"mate": -1, "mate_pos": 0, "tlen": 0, "mf": 0, "tags": draw.choice([[], [(b"NMC", b"\5"), (b"XZZ", b"text\0")], [(b"XBB", b"s" + struct.pack("<ihh", 2, -3, 4))]])}
    return r | more


def expected(reads):
    """Rows of reads of one list; fields of mates are given under want."""
    out = []
    for n, r in enumerate(reads):
        name = {"NM": ("i", 5, None), "XZ": ("Z", None, "text"), "XB": ("B", None, "s,-3,4")}
        tags = {t[:2].decode(): dict(zip("tis", name[t[:2].decode()])) for t, _ in r["tags"]}
        if r["group"] >= 0:
            tags["RG"] = {"t": "Z", "i": None, "s": f"g{r['group']}"}
        place = lambda p: p - 1 if p > 0 else None
        contig = lambda k: CONTIGS[k] if k >= 0 else None
        row = {"rid": n, "qname": r["name"], "flag": r["flag"], "chrom": contig(r["ref"]), "pos0": place(r["pos"]), "mapq": r["mapq"], "cigar": [{"op": o, "len": k} for o, k in r["ops"]], "mate_chrom": contig(r["mate"]), "mate_pos0": place(r["mate_pos"]), "tlen": r["tlen"]}
        out.append(row | {"seq": r["seq"], "qual": r["qual"] if r["own"] & 1 else [], "tags": tags} | r.get("want", {}))
    return out


def collected(spark, path):
    return [r.asDict(True) for r in alignments.read_alignments(spark, str(path)).orderBy("rid").collect()]


@pytest.mark.parametrize("names, delta, methods", [(True, True, ["raw", "gzip", "rans0", "rans1"]), (False, False, ["bz2", "lzma", "rans1", "rans0", "gzip"])])
def test_cram(spark, tmp_path, names, delta, methods):
    draw = random.Random(1)
    places = [sorted(draw.randrange(1, 4000) for _ in range(25)) for _ in range(4)]
    lists = [(k % 2, [one(draw, 25 * k + i, k % 2, p) for i, p in enumerate(ps)]) for k, ps in enumerate(places)]
    mates = [one(draw, 200, 0, 50, flag=67, own=2, mate=1, mate_pos=77, tlen=0, mf=3, ops=[("M", 9)], seq=GENOME["chr1"][49:58]), one(draw, 201, 0, 60, own=3, mate=0, mate_pos=9, tlen=-40)]
    mates[0]["want"] = {"flag": 67 | 0x20 | 0x8, "qual": []}
    if names:
        pair = [one(draw, 300, 0, 100, flag=67, own=5, nf=0, ops=[("M", 10)], seq=GENOME["chr1"][99:109], qual=[3] * 10), one(draw, 301, 0, 150, flag=147, own=1, ops=[("M", 10)], seq=GENOME["chr1"][149:159], qual=[4] * 10)]
        pair[0]["want"] = {"flag": 67 | 0x20, "mate_chrom": "chr1", "mate_pos0": 149, "tlen": 60}
        pair[1]["want"] = {"qname": "r300", "mate_chrom": "chr1", "mate_pos0": 99, "tlen": -60}
        mates += pair
    lost = [one(draw, 400, 0, 0, flag=4, ops=[], mapq=0, seq="ACGTN", qual=[1, 2, 3, 4, 5]), one(draw, 401, 0, 0, flag=4, ops=[], mapq=0, seq="ACG", own=2, qual=[])]
    for r in lost:
        r["ref"] = -1
    coder = Encoder(methods, names, delta)
    containers = [lists[:2], lists[2:], [(0, mates)], [(-1, lost)]]
    (tmp_path / "a.cram").write_bytes(coder.file(containers))
    want = expected([r for c in containers for _, reads in c for r in reads])
    got = collected(spark, tmp_path / "a.cram")
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w
    parts = cram.CramReader({"path": f"{tmp_path}/a.cram,{tmp_path}/a.cram", "split": 1}).partitions()
    assert len(parts) == 8
    twice = [r.asDict(True) for r in cram.read_cram(spark, f"{tmp_path}/a.cram,{tmp_path}/a.cram").orderBy("rid").collect()]
    assert twice == [r | {"rid": i} for i, r in enumerate([*want, *want])]


def test_cram_without_reference(spark, tmp_path):
    """Bases are written out; several contigs share a slice; a file that needs an outside reference is an error."""
    draw = random.Random(2)
    reads = [one(draw, i, i % 2, 100 + i, own=3) for i in range(20)]
    for r in reads[::5]:
        r |= {"own": 2, "ops": [("M", 12)], "seq": r["seq"][:12], "some_qual": [7, 8, 9], "want": {"qual": [7, 8, 9] + [255] * 9}}
    (tmp_path / "a.cram").write_bytes(Encoder(["raw"], delta=False, embedded=False).file([[(-2, reads)]]))
    assert collected(spark, tmp_path / "a.cram") == expected(reads)
    coder = Encoder(["raw"], delta=False)
    (tmp_path / "b.cram").write_bytes(coder.file([[(-2, reads[:3])]]))
    with pytest.raises(Exception, match="outside reference"):
        collected(spark, tmp_path / "b.cram")
    (tmp_path / "c.cram").write_bytes(coder.file([]))
    assert collected(spark, tmp_path / "c.cram") == []
    (tmp_path / "d.cram").write_bytes(b"CRAM\2\1" + b"\0" * 30)
    with pytest.raises(Exception, match="version 2"):
        collected(spark, tmp_path / "d.cram")

