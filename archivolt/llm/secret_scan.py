"""Secrets in texts: plain patterns, and encoded candidates confirmed by decoding their structure."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivolt.llm.common import packed, slices, texts_of

BASE_KINDS = ["assign", "access", "hex"]
#: All kinds in their order: the plain ones, then those that structure confirms.
KINDS = [*BASE_KINDS, "jwt", "pem", "der", "ssh"]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----((?:\s|\\[nrt])*+)((?:[A-Za-z][A-Za-z0-9-]*+:[^\n\\]*+(?:\s|\\[nrt])++)*+)((?:[A-Za-z0-9+/=]++|\s++|\\[nrt])*+)")
_PEM_END = re.compile(r"-----END ([A-Z0-9 ]{0,40}KEY)-----")
_LEGACY = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,([0-9A-Fa-f]{16,32})\b")
_BREAK = re.compile(r"\s|\\[nrt]")
_PEM_LINE = re.compile(r"(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*+)?([A-Za-z0-9+/]++={0,2})")
#: What DER (0x30 and a length of 1..4 bytes) and length-prefixed or OpenSSH keys start with in base64; other runs can't decode to them.
_HEAD = re.compile(r"(?<![A-Za-z0-9])(?:M[A-I]|AAAA|b3BlbnNzaC1r)[A-Za-z0-9+/_-]{28}")
_REST = re.compile(r"(\r?\n[ \t]*+)?([A-Za-z0-9+/_-]++)")
_HEX_HEAD = re.compile(r"(?<![0-9A-Fa-f])(?:30|0000|6[Ff]70656[Ee])[0-9A-Fa-f]{58,}")
#: Bytes of the longest key that is looked for; one of 16,384 bits takes some 9,500.
LONGEST_KEY = 1 << 16


def decoded(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, padded or not; None if it isn't one."""
    run = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER items that fill data exactly, nested lengths checked too; None if they don't."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            n = int.from_bytes(data[at : at + wide])
            if n < 0x80 or data[at] == 0:  # DER takes the shortest form
                return None
            at += wide
        if at + n > len(data):
            return None
        content = data[at : at + n]
        if tag & 0x20 and (depth > 16 or der_items(content, depth + 1) is None):
            return None
        out.append((tag, content))
        at += n
    return out


def der_length(data: bytes) -> int | None:
    """Bytes of the SEQUENCE at the head of data as its header tells; None if there is no such header or it says over LONGEST_KEY."""
    if len(data) < 2 or data[0] != 0x30:
        return None
    n, wide = data[1], 0
    if n & 0x80:
        wide = n & 0x7F
        n = int.from_bytes(data[2 : 2 + wide]) if 1 <= wide <= 4 and len(data) >= 2 + wide else 0
        if n < 0x80 or data[2] == 0:
            return None
    return 2 + wide + n if 32 <= 2 + wide + n <= LONGEST_KEY else None


def opens_key(data: bytes) -> bool:
    """Whether a key can begin so: in its SEQUENCE a version, a large number, or an algorithm or its parameters."""
    if der_length(data) is None or len(data) < 16:
        return False
    at = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    if data[at] == 0x02:
        return data[at + 1] == 1 and data[at + 2] <= 3 or data[at + 1] >= 0x40
    return data[at] == 0x30 and (data[at + 2] == 0x06 or data[at + 1] & 0x80 > 0)


#: Object identifiers of password-based encryption, PKCS#5 and PKCS#12.
_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def is_der_key(data: bytes) -> bool:
    """Whether data is one SEQUENCE laid out as a private or public key: PKCS#8, plain or encrypted, PKCS#1, DSA, SEC1 or SubjectPublicKeyInfo."""
    if len(data) < 32 or data[0] != 0x30:
        return False
    whole = der_items(data)
    if not whole or len(whole) != 1:
        return False
    items = der_items(whole[0][1]) or []
    tags = [t for t, _ in items]
    if tags[:3] == [0x02, 0x30, 0x04] and len(items[0][1]) == 1:  # version, algorithm, key
        return True
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # numbers of an RSA key
        return True
    if tags == [0x02] * 6 and items[0][1] == b"\x00":  # numbers of a DSA key
        return True
    if tags == [0x02] * 2 and len(items[0][1]) >= 64 and 1 <= len(items[1][1]) <= 8:  # modulus, exponent
        return True
    if tags[:2] == [0x02, 0x04] and items[0][1] == b"\x01":  # elliptic curve key
        return True
    if tags in ([0x30, 0x03], [0x30, 0x04]):  # algorithm, public key or encrypted one
        inner = der_items(items[0][1])
        if not inner or inner[0][0] != 0x06:
            return False
        return tags[1] == 0x03 or inner[0][1].startswith(_ENCRYPTION)
    return False


def is_ssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH key: its magic, or length-prefixed strings that begin with a key type."""
    if data.startswith(b"openssh-key-v1\x00"):
        return True
    fields, at = [], 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4])
        at += 4
        if n > len(data) - at:
            return False
        fields.append(data[at : at + n])
        at += n
    return at == len(data) and len(fields) >= 2 and re.match(rb"(ssh-|ecdsa-sha2-|sk-)[a-z0-9@.-]+$", fields[0]) is not None


def is_signed_token(run: str) -> bool:
    """Whether the first of three parts is a JSON object with an algorithm and the second a JSON object, or of five parts (an
    encrypted token) the first tells both algorithms."""
    parts = run.split(".")
    try:
        header = json.loads(decoded(parts[0]) or b"")
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        return len(parts) == 5 and isinstance(header.get("enc"), str) or isinstance(json.loads(decoded(parts[1]) or b""), dict)
    except (ValueError, RecursionError):
        return False


def pem_end(m: re.Match) -> int | None:
    """Where the key block ends whose BEGIN line, headers and body m has matched; None if its content doesn't parse.

    With an END line the whole body has to be a key, or ciphertext of whole blocks under a DEK-Info header. Without one the block
    ends with the key that its lines begin with; if they are cut off, they have to begin as a key does.
    """
    text, body = m.string, _BREAK.sub("", m[4].replace("\\n", "\n").replace("\\r", "\n").replace("\\t", "\n"))
    closed = _PEM_END.match(text, m.end())
    data = decoded(body)
    if (iv := _LEGACY.search(m[3])) and len(iv[1]) in (16, 32):
        if closed and data and len(data) % 8 == 0:
            return closed.end()
        return None
    if closed and closed[1] == m[1]:
        return closed.end() if data and (is_der_key(data) or is_ssh_key(data)) else None
    lines, at = [], m.start(4)
    while line := _PEM_LINE.match(text, at, m.end()):
        if lines and len(line[1]) > len(lines[0]):
            break
        lines.append(line[1])
        at = line.end()
        if len(line[1]) < len(lines[0]):
            break
    while lines:
        data = decoded("".join(lines))
        n = der_length(data or b"")
        if data and (n is not None and (is_der_key(data[:n]) if n <= len(data) else len(data) >= 48 and opens_key(data)) or is_ssh_key(data)):
            return at
        if len(lines) < 2 or len(lines[-1]) == len(lines[0]):
            return None
        at -= len(lines.pop())  # a word after the key, shorter than its lines
        at = m.start(4) + len(text[m.start(4) : at].rstrip())
    return None


_SIGN = re.compile(r"[A-Za-z0-9+/_-]")


def bytes_at(text: str, at: int, first: int, last: int) -> bytes:
    """Bytes first..last of the base64 run that begins at a place; fewer where it ends or breaks off."""
    run = text[at + first // 3 * 4 : at + -(-last // 3) * 4]
    return (decoded(run) or b"")[first % 3 :][: last - first]


def ssh_end(text: str, at: int) -> int | None:
    """Where the SSH key ends whose base64 begins at a place: its length-prefixed fields, read one by one, end with the run."""
    magic = bytes_at(text, at, 0, 15) == b"openssh-key-v1\x00"
    if not magic and not re.match(rb"\x00\x00\x00.(ssh-|ecdsa-sha2-|sk-)", bytes_at(text, at, 0, 15), re.S):
        return None
    place, fields, left = 15 * magic, 0, None
    while place <= LONGEST_KEY and fields < 32:
        if magic and fields == 3 and left is None:  # cipher, key derivation and its options, then the number of public keys
            left = int.from_bytes(bytes_at(text, at, place, place + 4)) + 1
            place += 4
            if not 2 <= left <= 16:
                return None
        size = bytes_at(text, at, place, place + 4)
        if len(size) < 4:
            return None
        place += 4 + int.from_bytes(size)
        fields += 1
        end = at + -(-place * 4 // 3)
        if end > len(text):
            return None
        if (fields - 3 == left) if magic else (fields > 1 and not _SIGN.match(text, end)):
            data = None if _SIGN.match(text, end) else decoded(text[at:end])
            return re.compile("={0,2}").match(text, end).end() if data and is_ssh_key(data) else None
    return None


def bare_key(text: str, at: int) -> tuple[str, int] | None:
    """(kind, end) of a key in base64 that begins at a place; None if there is none. DER keys may go on over lines.

    A key tells its own length, so only as many characters are looked at, and no further one may follow.
    """
    head = decoded(text[at : at + 32]) or b""
    if not opens_key(head):
        return ("ssh", end) if (end := ssh_end(text, at)) else None
    need = der_length(head)
    left, got, end = -(-need * 4 // 3), [], at
    while left and (m := _REST.match(text, end, end + 16 + left)):
        if m[1] and not got:
            return None
        got.append(m[2][:left])
        left -= len(got[-1])
        end = m.start(2) + len(got[-1])
    if left or _SIGN.match(text, end):
        return None
    data = decoded("".join(got))
    return ("der", re.compile("={0,2}").match(text, end).end()) if data and is_der_key(data[:need]) else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of encoded secrets whose structure parses: signed and encrypted tokens, PEM blocks, bare DER and SSH keys in base64 or hex."""
    out = []
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    inside = 0  # up to here a block or key has been told
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            if end := pem_end(m):
                out.append(("pem", m.start(), end))
    blocks = [s[1:] for s in out if s[0] == "pem"]
    for m in _HEAD.finditer(text):
        while blocks and blocks[0][1] <= m.start():
            blocks.pop(0)
        if m.start() >= inside and not (blocks and blocks[0][0] <= m.start()) and (key := bare_key(text, m.start())):
            out.append((key[0], m.start(), key[1]))
            inside = key[1]
    for m in _HEX_HEAD.finditer(text):
        if len(m[0]) % 2 == 0 and len(m[0]) <= 2 * LONGEST_KEY:
            data = bytes.fromhex(m[0])
            if is_der_key(data):
                out.append(("der", m.start(), m.end()))
            elif is_ssh_key(data):
                out.append(("ssh", m.start(), m.end()))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans) -> str:
    """text with every stretch that spans cover replaced by [kind], the kind of the first span of the stretch."""
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, a, b = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < b:
            k += 1
            b = max(b, spans[k][2])
        out += [text[at:a], f"[{kind}]"]
        at, k = b, k + 1
    return "".join([*out, text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RESULT = [T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType()), T.StructField("clean_text", T.StringType())]


def _scanned(want_clean: bool, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at):
                cols = {f.name: [] for f in RESULT}
                for text in texts_of(part, text_at).to_pylist():
                    base = ordered(base_spans(text))
                    spans = ordered([*base, *confirmed_spans(text)])
                    for k in BASE_KINDS:
                        cols[f"n_{k}"].append(sum(s[0] == k for s in base))
                    cols["base_sha256"].append(sha256(joined(base).encode()).hexdigest())
                    cols["spans"].append(joined(spans))
                    cols["n_spans"].append(len(spans))
                    cols["clean_text"].append(redacted(text, spans) if want_clean and spans else None)
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(v, t) for v, t in zip(cols.values(), kinds))], ["row", *cols])

    return run


def scan_secrets(docs: DataFrame, text_col: str = "text", clean: bool = False) -> DataFrame:
    """docs packed as `row`, with n_assign, n_access, n_hex, base_sha256, spans, n_spans and clean_text.

    spans: kind:start:end in code points, end exclusive, by start, then kind; n_spans: their number. clean_text (only if clean): the
    text with secrets replaced by [kind], null where there are none. Base patterns are reported as they
    match; jwt, pem, der and ssh only once the candidate decodes and its lengths, key layout or token header
    parse. Blocks without their END line and encrypted ones (headers, whole cipher blocks) are told too; bare keys may go on over
    lines. Null and empty texts have no spans. Texts are scanned whole, however long. Repeated rows are scanned
    each. Other columns stay in `row`, whatever their names; an empty table gives no rows.
    """
    rows, at = packed(docs, text_col)
    return rows.mapInArrow(_scanned(clean, at), T.StructType([rows.schema["row"], *RESULT]))


def without_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with each secret replaced in the text, and its length put right where docs has one. No row is lost."""
    found = scan_secrets(docs, text_col, clean=True)
    text = F.coalesce("clean_text", F.col(f"row.`{text_col}`"))
    new = {text_col: text}
    if chars_col in docs.columns:
        old = F.col(f"row.`{chars_col}`")
        new[chars_col] = F.when(F.col("clean_text").isNull(), old).otherwise(F.length("clean_text").cast(docs.schema[chars_col].dataType))
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
