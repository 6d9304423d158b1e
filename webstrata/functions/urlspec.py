"""URLs by the living standard, as far as http and https need it: parsing, joining, canonical form, internal addresses."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, replace

from webstrata.functions.urls import TRACKING

DEFAULT_PORTS = {"http": 80, "https": 443}
#: Bytes that stay as they are in a path, a query and a fragment; all others are written %XX.
PATH_SAFE = frozenset(b"!$%&'()*+,-./0123456789:;=@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]_abcdefghijklmnopqrstuvwxyz|~")
QUERY_SAFE = frozenset(set(PATH_SAFE) | set(b"?^`{}")) - frozenset(b"'")
FORBIDDEN_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")


class UrlError(ValueError):
    """Why an address can't be filed: Unparseable, UnsupportedScheme, Hostless or UnsafeHost."""


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str
    host: str
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    @property
    def origin(self) -> tuple[str, str, int]:
        return self.scheme, self.host, self.port or DEFAULT_PORTS[self.scheme]

    def text(self) -> str:
        return "".join(
            (
                self.scheme,
                "://",
                self.user + "@" if self.user else "",
                self.host,
                f":{self.port}" if self.port else "",
                self.path,
                "" if self.query is None else "?" + self.query,
                "" if self.fragment is None else "#" + self.fragment,
            )
        )


def encoded(text: str, safe: frozenset[int]) -> str:
    return "".join(chr(b) if b in safe else f"%{b:02X}" for b in text.encode("utf-8", "replace"))


def cleaned(text: str) -> str:
    """Without controls and spaces around, tabs and line breaks within."""
    return re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))


def ipv4_of(host: str) -> str | None:
    """The address if the host's last label is a number; shorthand and octal or hexadecimal parts count. Raises if it is no address."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", parts[-1]):
        return None
    if len(parts) > 4:
        raise UrlError("Unparseable")
    numbers = []
    for p in parts:
        try:
            numbers.append(int(p[2:] or "0", 16) if p[:2] in ("0x", "0X") else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p))
        except ValueError:
            raise UrlError("Unparseable") from None
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise UrlError("Unparseable")
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def host_of(raw: str) -> str:
    if raw.startswith("["):
        if not raw.endswith("]"):
            raise UrlError("Unparseable")
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]"
        except ValueError:
            raise UrlError("Unparseable") from None
    text = re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), raw)
    if not text.isascii():
        try:
            import idna

            text = idna.encode(text, uts46=True, transitional=False).decode()
        except (ImportError, UnicodeError):
            try:
                text = text.encode("idna").decode()
            except UnicodeError:
                raise UrlError("Unparseable") from None
    text = text.lower()
    if not text or FORBIDDEN_HOST.search(text):
        raise UrlError("Unparseable")
    return ipv4_of(text) or text


def without_dots(path: str) -> str:
    """Dot segments resolved."""
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, part in enumerate(parts):
        plain, last = re.sub("%2[eE]", ".", part), i == len(parts) - 1
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def parse(text: str, base: Url | None = None) -> Url:
    """An absolute http(s) address, or a reference on a base."""
    text = cleaned(text)
    fragment = query = None
    text, mark, rest = text.partition("#")
    if mark:
        fragment = encoded(rest, QUERY_SAFE)
    scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*(?=:)", text)
    if scheme and not (base and scheme[0].lower() == base.scheme and not re.match(r"[/\\]", text[scheme.end() + 1 :])):
        kind, rest = scheme[0].lower(), text[scheme.end() + 1 :]
        if kind not in DEFAULT_PORTS:
            raise UrlError("UnsupportedScheme")
        rest = rest.lstrip("/\\")
    elif base is None:
        raise UrlError("Unparseable")
    else:
        rest = text[scheme.end() + 1 :] if scheme else text
        if not re.match(r"[/\\]{2}", rest):
            path, mark, asked = rest.partition("?")
            path = path.replace("\\", "/")
            if not path:
                return replace(base, query=encoded(asked, QUERY_SAFE) if mark else base.query, fragment=fragment)
            whole = path if path.startswith("/") else base.path.rpartition("/")[0] + "/" + path
            return replace(base, path=without_dots(encoded(whole, PATH_SAFE)), query=encoded(asked, QUERY_SAFE) if mark else None, fragment=fragment)
        kind, rest = base.scheme, rest.lstrip("/\\")
    rest, mark, asked = rest.partition("?")
    if mark:
        query = encoded(asked, QUERY_SAFE)
    cut = re.search(r"[/\\]", rest)
    authority, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "/")
    user, _, place = authority.rpartition("@")
    found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", place)
    if not found or not found[1]:
        raise UrlError("Unparseable")
    port = int(found[2]) if found[2] else None
    if port is not None and port > 65535:
        raise UrlError("Unparseable")
    return Url(kind, user, host_of(found[1]), None if port == DEFAULT_PORTS[kind] else port, without_dots(encoded(path.replace("\\", "/"), PATH_SAFE)), query, fragment)


def rewritten_host(host: str) -> str:
    """Trailing dots go, and each leading www. that leaves a dot."""
    if host.startswith("[") or re.fullmatch(r"[0-9.]+", host.rstrip(".")):
        return host
    host = host.rstrip(".")
    while host.startswith("www.") and "." in host[4:]:
        host = host[4:]
    return host


def host_directory(host: str) -> str | None:
    name = host.strip("[]").replace(":", "-").lower() if host.startswith("[") else host.lower()
    return name if re.fullmatch(r"[a-z0-9_-][a-z0-9._-]*", name) else None


def kept_query(query: str | None) -> str | None:
    kept = []
    for p in (query or "").split("&"):
        p = re.sub(r"\A(?:amp(?:;|%3b))+", "", p, flags=re.I)
        name = p.split("=", 1)[0].lower()
        if p and not name.startswith("utm_") and name not in TRACKING:
            kept.append(p)
    return "&".join(sorted(kept, key=lambda p: p.split("=", 1)[0])) or None


def canonical(text: str) -> tuple[str, str]:
    """(canonical URL, host directory); raises UrlError. Applying it again changes nothing."""
    url = parse(text)
    host = rewritten_host(url.host)
    if not host:
        raise UrlError("UnsafeHost")
    directory = host_directory(host)
    if directory is None:
        raise UrlError("UnsafeHost")
    return replace(url, user="", host=host, query=kept_query(url.query), fragment=None).text(), directory


def absolute(reference: str, base: Url | None) -> str | None:
    """A reference as an address without fragment; null if it isn't http(s)."""
    if base is None:
        return None
    try:
        return replace(parse(reference.strip(), base), fragment=None).text()
    except UrlError:
        return None


def page_base(final_url: str, base_href: str | None) -> tuple[Url | None, Url | None]:
    """(the page, what its references stand on)."""
    try:
        page = parse(final_url)
    except UrlError:
        return None, None
    if base_href:
        try:
            return page, parse(base_href.strip(), page)
        except UrlError:
            pass
    return page, page


#: Names that lead inside a network.
INTERNAL_NAMES = ("localhost", "metadata.google.internal", "metadata.goog")


def is_internal_host(host: str) -> bool:
    name = host.rstrip(".").lower()
    if name in INTERNAL_NAMES or name.endswith(".localhost"):
        return True
    try:
        address = ipaddress.ip_address(name.strip("[]"))
    except ValueError:
        return False
    if address.version == 6:
        if address.ipv4_mapped:
            return is_internal_host(str(address.ipv4_mapped))
        return address.is_loopback or address.is_unspecified or address in ipaddress.ip_network("fc00::/7") or address in ipaddress.ip_network("fe80::/10")
    inside = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "0.0.0.0/8", "255.255.255.255/32")
    return any(address in ipaddress.ip_network(n) for n in inside)


def points_inside(text: str) -> bool:
    try:
        return is_internal_host(parse(text).host)
    except UrlError:
        return False


def unusable(text: str, allow_private: bool = False) -> str | None:
    """Why an address isn't dialled; null if it is."""
    try:
        url = parse(text)
    except UrlError as e:
        return str(e)
    return "InsideANetwork" if not allow_private and is_internal_host(url.host) else None


def readable_destination(destination: str, base: Url | None) -> str | None:
    """Where a link of an article may lead: a fragment, or an http, https or mailto address; else null."""
    if destination.startswith("#"):
        return None if re.search(r"\s", destination) else destination
    if re.match(r"\s*mailto:", destination, re.I):
        return destination.strip()
    if re.match(r"\s*[A-Za-z][A-Za-z0-9+.-]*:", destination) and not re.match(r"\s*https?:", destination, re.I):
        return None
    try:
        return parse(destination, base).text()
    except UrlError:
        return None


def percent_decoded(text: str) -> str | None:
    """Strictly: null if an escape is malformed or the bytes aren't UTF-8. A plus sign stays."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return None
    try:
        return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode()).decode()
    except UnicodeDecodeError:
        return None
