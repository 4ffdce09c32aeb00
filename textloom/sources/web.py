"""What a fetcher may reach: private address ranges, robots.txt, retries. Fetching itself is left to a function that is passed in."""

from __future__ import annotations

import ipaddress
import random
import re
import time
from collections.abc import Callable
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Networks that no fetch may reach.
BLOCKED = tuple(
    ipaddress.ip_network(n)
    for n in (
        "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
        "::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32", "100::/64",
    )
)
REDIRECTS, ROBOTS_BYTES, RETRY_AFTER_S = 5, 512 << 10, 30.0


def blocked_reason(address: str) -> str | None:
    """Why an address may not be fetched, or None; addresses within mapped, translated and 6to4 ones count."""
    try:
        a = ipaddress.ip_address(address.split("%")[0])
    except ValueError:
        return "not an address"
    inner = [a]
    if a.version == 6:
        if a.ipv4_mapped:
            inner.append(a.ipv4_mapped)
        if a.sixtofour:
            inner.append(a.sixtofour)
        if a in ipaddress.ip_network("64:ff9b::/96"):
            inner.append(ipaddress.IPv4Address(int(a) & 0xFFFFFFFF))
    return next((str(n) for x in inner for n in BLOCKED if x.version == n.version and x in n), None)


def blocked_v4(octets: Column) -> Column:
    """The blocked network of dotted IPv4 addresses, or null, by number ranges: no join, for the ranges are literals."""
    parts = F.split(octets, r"\.")
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    out = F.lit(None).cast("string")
    for net in reversed([n for n in BLOCKED if n.version == 4]):
        out = F.when(n.between(int(net[0]), int(net[-1])), str(net)).otherwise(out)
    return F.when(octets.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), out)


def robots_rules(text: str, agent: str) -> list[tuple[bool, str]]:
    """(allowed, path pattern) rules of the group for an agent, else of the group for all."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    names: list[str] = []
    fresh = True
    for line in text[:ROBOTS_BYTES].splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            names = [value.lower()] if fresh else [*names, value.lower()]
            fresh = False
            for n in names:
                groups.setdefault(n, [])
        elif key in ("allow", "disallow"):
            fresh = True
            for n in names:
                if value:
                    groups[n].append((key == "allow", value))
    own = next((g for n, g in groups.items() if n != "*" and n and n in agent.lower()), None)
    return own if own is not None else groups.get("*", [])


def robots_allow(rules: list[tuple[bool, str]], path: str) -> bool:
    """The longest matching rule decides; of two equally long ones the one that allows."""
    best = (-1, True)
    for allowed, pattern in rules:
        p = re.escape(pattern.removesuffix("$")).replace(r"\*", ".*") + ("$" if pattern.endswith("$") else "")
        if re.match(p, path):
            best = max(best, (len(pattern), allowed))
    return best[1]


def retry_after(value: str | None) -> float | None:
    """Seconds of a Retry-After header, a number or a date, at most RETRY_AFTER_S."""
    if not value:
        return None
    try:
        s = float(value) if re.fullmatch(r"\d+(\.\d+)?", value.strip()) else parsedate_to_datetime(value).timestamp() - time.time()
    except (TypeError, ValueError):
        return None
    return min(max(0.0, s), RETRY_AFTER_S)


def backoff(attempt: int, base_s: float = 0.5, most_s: float = 30.0, rand: Callable[[], float] = random.random) -> float:
    """Full jitter over an exponentially growing bound."""
    return rand() * min(most_s, base_s * 2**attempt)


def fetch(url: str, get: Callable[[str], tuple[int, dict, bytes]], resolve: Callable[[str], list[str]], retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[str, dict, bytes]:
    """(final url, headers, body) by get; every hop's host must resolve to public addresses only; 429, 5xx and broken connections are tried again."""
    for _ in range(REDIRECTS + 1):
        u = urlsplit(url)
        if u.scheme not in ("http", "https") or not u.hostname or u.username:
            raise ValueError(f"{url} can't be fetched")
        for a in resolve(u.hostname):
            if why := blocked_reason(a):
                raise ValueError(f"{u.hostname} is in {why}")
        for attempt in range(retries + 1):
            try:
                status, headers, body = get(url)
            except OSError:
                if attempt == retries:
                    raise
                sleep(backoff(attempt))
                continue
            if status != 429 and status < 500 or attempt == retries:
                break
            sleep(retry_after(headers.get("retry-after")) or backoff(attempt))
        if status in (301, 302, 303, 307, 308) and headers.get("location"):
            url = urljoin(url, headers["location"])
            continue
        if status >= 400:
            raise ValueError(f"{url} answered {status}")
        return url, headers, body
    raise ValueError("too many redirects")
