"""Hand-made H.264 and H.265 streams for the carving tests, written bit by bit."""

import random


class Writer:
    def __init__(self):
        self.bits = ""

    def u(self, n, v):
        self.bits += format(v, f"0{n}b") if n else ""
        return self

    def ue(self, v):
        self.bits += "0" * ((v + 1).bit_length() - 1) + format(v + 1, "b")
        return self

    def se(self, v):
        return self.ue(2 * v - 1 if v > 0 else -2 * v)

    def done(self):
        text = self.bits + "1"
        text += "0" * (-len(text) % 8)
        return escaped(int(text, 2).to_bytes(len(text) // 8, "big"))


def escaped(data):
    out = bytearray()
    for b in data:
        if out[-2:] == b"\0\0" and b <= 3:
            out.append(3)
        out.append(b)
    return bytes(out)


def sps264(own=0, profile=66, width=20, height=15, frame_bits=4, chroma=1, scaling=False, poc=2, level=30):
    w = Writer().u(8, profile).u(8, 0).u(8, level).ue(own)
    if profile >= 100:
        w.ue(chroma)
        if chroma == 3:
            w.u(1, 0)
        w.ue(0).ue(0).u(1, 0).u(1, scaling)
        for k in range((12 if chroma == 3 else 8) if scaling else 0):
            w.u(1, k % 2)
            for j in range((16 if k < 6 else 64) if k % 2 else 0):
                w.se((j % 5) - 2)
    w.ue(frame_bits - 4).ue(poc)
    if poc == 0:
        w.ue(4)
    if poc == 1:
        w.u(1, 0).se(-3).se(5).ue(2).se(1).se(-1)
    return b"\x67" + w.ue(2).u(1, 0).ue(width - 1).ue(height - 1).u(1, 1).u(1, 1).u(1, 0).u(1, 0).done()


def pps264(own=0, refers=0):
    return b"\x68" + Writer().ue(own).ue(refers).u(1, 0).u(1, 0).ue(0).ue(0).ue(0).u(1, 0).u(2, 0).se(0).se(0).se(0).u(3, 0).done()


def slice264(rng, frame, idr=False, pps=0, size=40, frame_bits=4, kind=None):
    w = Writer().ue(0).ue((7 if idr else 5) if kind is None else kind).ue(pps).u(frame_bits, frame % (1 << frame_bits))
    return (b"\x65" if idr else b"\x41") + escaped(w.done() + bytes(rng.randrange(1, 256) for _ in range(size)))


def vps265(own=0):
    return b"\x40\x01" + Writer().u(4, own).u(2, 3).u(6, 0).u(3, 0).u(1, 1).u(16, 0xFFFF).u(8, 1).done()


def sps265(own=0, vps=0, width=320, height=240, layers=0):
    w = Writer().u(4, vps).u(3, layers).u(1, 1).u(2, 0).u(1, 0).u(5, 1).u(32, 0x60000000).u(4, 9).u(44, 0).u(8, 93)
    return b"\x42\x01" + w.ue(own).ue(1).ue(width).ue(height).u(4, 0).done()


def pps265(own=0, sps=0):
    return b"\x44\x01" + Writer().ue(own).ue(sps).u(7, 0).ue(0).ue(0).se(0).u(3, 0).u(4, 5).done()


def slice265(rng, irap=False, pps=0, size=40):
    w = Writer().u(1, 1)
    if irap:
        w.u(1, 0)
    return (b"\x26\x01" if irap else b"\x02\x01") + escaped(w.ue(pps).done() + bytes(rng.randrange(1, 256) for _ in range(size)))


def stream(units, rng=None):
    """Annex B: a start code of four bytes, or of three, before each unit."""
    return b"".join((b"\0\0\0\1" if rng is None or k == 0 or rng.random() < 0.6 else b"\0\0\1") + u for k, u in enumerate(units))


def clip264(seed, pictures=12, access=6, repeat=True, pps=0, sps=0, **kw):
    rng, units, frame = random.Random(seed), [], 0
    for k in range(pictures):
        if k % access == 0:
            frame = 0
            if k == 0 or repeat:
                units += [sps264(sps, **kw), pps264(pps, sps)]
        units.append(slice264(rng, frame, k % access == 0, pps, rng.randint(10, 90), kw.get("frame_bits", 4)))
        frame += 1
    return stream(units, rng)


def clip265(seed, pictures=12, access=6):
    rng, units = random.Random(seed), []
    for k in range(pictures):
        if k % access == 0:
            units += [vps265(), sps265(), pps265()]
        units.append(slice265(rng, k % access == 0, 0, rng.randint(10, 90)))
    return stream(units, rng)


def noise(seed, size):
    """Bytes without two zeros in a row."""
    rng = random.Random(seed)
    return bytes(rng.randrange(1, 256) for _ in range(size))
