"""Recorders by their signatures, against a plain scan of whole images."""

import struct

from spanloom.operators import framing, identify
from spanloom.sources import images
from tests.test_sequences import frame, noise


def header(flag=0x82, length=100, time=1_700_000_000_000_000, unit=0x65, code=b"\0\0\0\1"):
    return bytes([flag]) + b"\x80\x01\x00" + bytes(4) + struct.pack("<I", length) + struct.pack("<Q", time) + code + bytes([unit])


def made():
    machine = noise(5, identify.MACHINE_AT) + b"..HN35080200.." + noise(6, 600)
    return {
        1: frame(0xFD, 1, 1, b"a", 4) + noise(1, 50) + frame(0xFC, 1, 2, b"b") + frame(0xF0, 1, 3) + frame(0xEE, 1, 4) + frame(0xFC, 1, 5, trailer=False) + frame(0xFC, 1, 1, ext=bytes([0x99] + [0] * 30), length=40),
        2: b"DAHUA" + noise(2, 100), 3: noise(3, 0x200) + identify.MASTER + noise(4, 10), 4: noise(3, 40) + identify.MASTER + b"..HIKBTREE..", 5: b"..RATS\x14\0\0\0..RATS....RATS", 6: machine + header() + header(0x02, 1 << 30, 5) + header(0x02) + header(unit=0x7F) + header(0x55) + header(),
        7: header() + header(), 8: noise(9, 300), 9: b"DHAV", 10: b"\x80\x01\x00" + header()[4:], 11: frame(0xFD, 1, 1, b"a") * 3 + identify.MASTER + b"HIKBTREE",
    }


def test_identification(spark):
    for chunk in (64, 1 << 20):
        chunks = images.chunked(spark.createDataFrame(list(made().items()), "img long, bytes binary"), chunk, framing.OVERLAP)
        found = identify.identification(chunks, chunk)
        got = {(r.img, r.signature): r for r in found.collect()}
        assert len(got) == len(made()) * len(identify.VENDOR_OF)
        n = lambda img, s: (got[img, s].accepted, got[img, s].rejected)
        assert n(1, "dahua_dhav_frame") == (3, 3) and got[1, "dahua_dhav_frame"].offsets[0] == 0
        assert n(2, "dahua_file_prefix") == (1, 0) and n(3, "hik_master_0x200") == (1, 0) and n(3, "hik_master_any") == (1, 0) and n(4, "hik_btree") == (1, 0)
        assert n(5, "hik_rats_log") == (1, 2) and got[5, "hik_rats_log"].offsets == [2] and got[5, "hik_rats_log"].rejected_offsets == [12, 20]
        assert n(6, "honeywell_custom_header") == (3, 3) and n(6, "honeywell_machine_data") == (1, 0) and n(10, "honeywell_custom_header") == (0, 1)
        assert got[8, "honeywell_machine_data"].reason == "image ends before the documented offset" and got[8, "hik_btree"].reason == "pattern not present"
        assert got[8, "dahua_file_prefix"].reason == "bytes at the documented offset differ" and got[9, "dahua_dhav_frame"].reason == "every occurrence failed the documented validation"
        data = made()
        for name, pattern in identify.PATTERNS.items():
            for img, d in data.items():
                at = [k for k in range(len(d)) if d.startswith(pattern, k)]
                assert got[img, name].candidates == len(at) and sorted([*got[img, name].offsets, *got[img, name].rejected_offsets]) == at
        rows = {(r.img, r.vendor): (r.confidence, r.best, r.ambiguous) for r in identify.matches(found).collect()}
        assert rows == {
            (1, "Dahua"): ("medium", True, False), (2, "Dahua"): ("low", True, False), (3, "Hikvision"): ("medium", True, False), (4, "Hikvision"): ("medium", True, False), (5, "Hikvision"): ("low", True, False),
            (6, "Honeywell"): ("medium", True, False), (7, "Honeywell"): ("low", True, False), (11, "Dahua"): ("medium", True, True), (11, "Hikvision"): ("medium", False, True),
        }
