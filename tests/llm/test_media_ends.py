"""PDF and FLAC objects end where they end, also with others behind them."""

from stratagraph.llm import media


def pdf(body: bytes, more: bytes = b"") -> bytes:
    def part(head: bytes) -> bytes:
        return head + b"xref\n0 0\ntrailer <<>>\nstartxref\n%d\n%%%%EOF" % len(head)

    one = part(b"%PDF-1.4\n" + body)
    return part(one + b"\n" + more) if more else one


def crc(data: bytes, poly: int, bits: int) -> int:
    c = 0
    for b in data:
        c ^= b << bits - 8
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> bits - 1 else 0)) & (1 << bits) - 1
    return c


def flac(frames: int) -> bytes:
    out = b"fLaC" + b"\x80\0\0\x22" + b"\x10\0\x10\0" + bytes(6) + b"\x0a\xc4\x42\xf0" + bytes(20)
    for i in range(frames):
        head = b"\xff\xf8\xc9\x18" + bytes([i])
        frame = head + bytes([crc(head, 0x07, 8)]) + bytes((7 * j + i) % 251 for j in range(300))
        out += frame + crc(frame, 0x8005, 16).to_bytes(2)
    return out


def test_pdfs_end_at_their_own_last_revision():
    one, two = pdf(b"a\n"), pdf(b"b\n", b"1 0 obj\nendobj\n")
    gif = b"GIF89a\x01\0\x01\0\0\0\0\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\0\x3b"
    data = one + b"..." + gif + two + b"--" + one + one
    at = [0, len(one) + 3, len(one) + 3 + len(gif), len(data) - 2 * len(one), len(data) - len(one)]
    assert list(media.objects(data)) == [(at[0], len(one), "application/pdf"), (at[1], len(gif), "image/gif"), (at[2], len(two), "application/pdf"), (at[3], len(one), "application/pdf"), (at[4], len(one), "application/pdf")]
    outer = pdf(b"stream\n" + one + b"\nendstream\n")
    assert list(media.objects(outer + b" ")) == [(0, len(outer), "application/pdf")]


def test_flac_ends_with_its_frames():
    png, sound = media.store(bytes(64)), flac(3)
    assert len(sound) == 42 + 3 * 308
    for gap in (b"", b"some text"):
        data = sound + gap + png + sound
        assert list(media.objects(data)) == [(0, len(sound), "audio/flac"), (len(sound + gap), len(png), "image/png"), (len(sound + gap + png), len(sound), "audio/flac")]
    broken = sound[:60]
    assert list(media.objects(broken + png)) == [(0, 60, "audio/flac"), (60, len(png), "image/png")]
