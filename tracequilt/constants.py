"""Labels, port tables, word lists, limits and defaults.

These must equal what users of the original tool see, so they are stated here
as plain data and nowhere else.
"""

# --- fixed values: transport labels in tie-break order
PROTO_ORDER = ("tcp", "udp", "icmp", "icmpv6", "arp", "other")

# --- fixed values: TCP flag bits
FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = 1, 2, 4, 8, 16, 32, 64, 128

# --- fixed values: TCP state labels, indexed by the class number used in aggregates
TCP_STATES = ("INIT", "SYN_ACK", "ESTABLISHED", "FIN", "RST")

# --- fixed values: service confidence, indexed by rank
CONFIDENCES = ("low", "medium", "high")

# --- fixed values: service names by transport and port
TCP_SERVICES = {
    20: "ftp", 21: "ftp", 22: "ssh", 25: "smtp", 53: "dns", 80: "http",
    110: "pop3", 143: "imap", 443: "https", 465: "smtps", 587: "submission",
    853: "dns-over-tls",
}
UDP_SERVICES = {53: "dns", 67: "dhcp", 68: "dhcp", 123: "ntp", 443: "quic", 5353: "mdns"}
WELL_KNOWN_MAX_PORT = 1024

# --- fixed values: proxy and peer-to-peer ports
PROXY_PORTS = (1080, 1081, 3128, 7890, 7891, 8080, 8081, 8082, 8118, 8123, 8888,
               9050, 9051, 9150, 9222, 10808)
P2P_PORTS = (6771, 6881, 6882, 6883, 6884, 6885, 6886, 6887, 6888, 6889, 6969, 51413)

# --- fixed values: needles of the peer-to-peer / proxy detectors
PROCESS_NEEDLES = (
    "transmission", "utorrent", "qbittorrent", "deluge", "rtorrent", "aria2",
    "v2ray", "xray", "clash", "sing-box", "singbox", "trojan", "shadowsocks",
    "ss-local", "proxifier", "tor", "privoxy", "openvpn", "wireguard", "tailscale",
)
SNI_NEEDLES = ("cloudflare-relay", "torproject.org", "onion.")
SERVICE_NEEDLES = ("bittorrent", "torrent")

# --- fixed values: CEF severity by label (0-10) and syslog severity nibble (0-7)
CEF_SEVERITY = {
    "info": 3, "low": 3, "informational": 3, "medium": 5, "med": 5, "warning": 6,
    "warn": 6, "high": 8, "error": 8, "err": 8, "critical": 10, "crit": 10, "fatal": 10,
}
CEF_SEVERITY_DEFAULT = 5
SYSLOG_SEVERITY = {
    "info": 6, "low": 6, "informational": 6, "medium": 4, "med": 4, "warning": 4,
    "warn": 4, "high": 3, "error": 3, "err": 3, "critical": 2, "crit": 2, "fatal": 2,
}
SYSLOG_SEVERITY_DEFAULT = 5
SYSLOG_FACILITY = 16
FLOW_SYSLOG_SEVERITY = 6

# --- fixed values: link types (DLT / LINKTYPE numbers)
LINK_NULL, LINK_ETHERNET, LINK_RAW_DLT, LINK_RAW = 0, 1, 12, 101
LINK_LOOP, LINK_SLL, LINK_IPV4, LINK_IPV6, LINK_SLL2 = 108, 113, 228, 229, 276

# --- fixed values: limits and defaults
TOP_N_DEFAULT, TOP_N_MAX = 10, 100
POOL_ROWS = 100
LIVE_TICK_WINDOW = 30
TIMELINE_POINTS = 160
MAX_FINDINGS = 30
COOLDOWN_SECONDS = {"threshold": 30, "entity": 20, "dpi": 60}
SNI_WINDOW_DEFAULT, SNI_WINDOW_MAX = 512, 16_384
SNI_MAX_NAME = 253
PTR_TTL_SECONDS, PTR_NEGATIVE_TTL_SECONDS = 300, 45
PROCESS_TTL_SECONDS, PROCESS_NEGATIVE_TTL_SECONDS = 60, 3
FLOW_EXPORT_MIN_BYTES, FLOW_EXPORT_DELTA_BYTES, FLOW_EXPORT_INTERVAL_SECONDS = 10_000, 1_000_000, 60

# --- fixed values: filter fields of a connection, the fields of a free-text search, and what a pivot's kind filters
FILTER_FIELDS = {
    "source": "source_address", "destination": "destination_address", "service": "service_name",
    "protocol": "protocol", "direction": "direction", "process": "process_name", "sni": "sni",
}
SEARCH_FIELDS = ("source_address", "destination_address", "service_name", "protocol", "process_name", "sni")
PIVOTS = {
    "host": "search", "peer": "search", "connection": "search", "sni": "sni", "service": "service",
    "process": "process", "src": "source", "source": "source", "dst": "destination",
    "destination": "destination", "country": "country", "region": "country",
}
