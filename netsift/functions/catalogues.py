"""Thresholds, word lists, patterns and address blocks the rules are defined by."""

# --- fixed values: low-rate beacon detector -------------------------------------------------
CADENCE_WINDOW_DAYS = 14
CADENCE_MIN_DAYS = 5
CADENCE_MAX_PER_DAY = 6
CADENCE_MIN_CONSISTENCY = 0.8

# --- fixed values: daily network panels -----------------------------------------------------
NIGHT_FIRST_HOUR, NIGHT_LAST_HOUR = 1, 5
NIGHT_MIN_CONNS = 5
NXDOMAIN_MIN_QUERIES = 30
NXDOMAIN_MIN_SHARE = 0.25
ENTROPY_MIN_BITS = 3.5
ENTROPY_MIN_LABEL = 8
EXFIL_MIN_MB = 10.0
JA4_LOOKBACK_DAYS = 2
JA4_FADE_DAYS = 14
RECENT_SECTIONS = 3
TOP_BEACON_SCORE = 0.80
REPORT_FILES_PERSIST = 14
REPORT_FILES_BEFORE = 7

# --- fixed values: relay detector -----------------------------------------------------------
RELAY_MAX_HOURS = 2.0
RELAY_MIN_KBPS = 30.0
RELAY_MIN_SECONDS = 300
RELAY_ALERTS_PER_DEVICE = 5
RELAY_LONGPOLL_SUFFIX = ".trouter.teams.microsoft.com"
RELAY_CIDRS = ["52.112.0.0/14", "52.122.0.0/15"]
RELAY_SNI_SUFFIXES = [
    ".teams.microsoft.com", ".teams.cloud.microsoft", ".lync.com", ".skype.com",
    ".skypeforbusiness.com", ".skypeassets.com", ".mediaservices.windows.net",
    ".teams.cdn.office.net", ".sfbassets.com",
]
RELAY_SNI_EXACT = [
    "teams.microsoft.com", "teams.cloud.microsoft", "adl.windows.com", "aka.ms",
    "join.secure.skypeassets.com", "mlccdnprod.azureedge.net",
]

# --- fixed values: alert handling, telemetry, data quality ----------------------------------
ALERT_TTL_HIGH_HOURS = 6
ALERT_TTL_OTHER_HOURS = 1
P1_REPEAT_MIN = 5
RATE_COUNT, RATE_SECONDS = 3, 300
FAILURE_THRESHOLD = 3
GAUGE_WINDOW, GAUGE_THRESHOLD = 60, 60.0
GAUGE_RESET_WINDOW, GAUGE_RESET_BELOW = 30, 50.0
GAUGE_REALERT_HOURS = 4
CAPTURE_SECONDS, CAPTURE_OK_ROWS = 300, 10
FRESH_WARN_SECONDS, FRESH_FAIL_SECONDS = 5400, 21600
INFRA_NOISE_PREFIXES = ("SURICATA STREAM", "SURICATA QUIC")

# --- fixed values: asset and intel windows --------------------------------------------------
ASSET_HISTORY_DAYS = 14
INTEL_TTL_DAYS, INTEL_LOOKBACK_DAYS, INTEL_GC_DAYS, INTEL_MAX_PER_RUN = 30, 7, 60, 800

# --- fixed values: severities ---------------------------------------------------------------
SEVERITY_RANK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
TLS_ISSUE_RANK = {"expired": 0, "self-signed": 1, "no-sni": 2}
L2_SEVERITY_RANK = {"critical": 0, "warning": 1, "info": 2}
HOT_SCAN_TAGS = ["tor", "vpn", "proxy", "honeypot", "compromised", "malware", "ics", "nuclear"]

# --- fixed values: address blocks -----------------------------------------------------------
LAN_CIDRS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]
EXIT_NETS = ["162.247.241.0/24", "162.247.72.0/24", "199.87.154.0/24", "176.10.104.0/24", "185.220.101.0/24"]
VENDOR_NETS = [
    ("17.0.0.0/8", "Apple"), ("20.0.0.0/8", "Microsoft Azure"), ("40.0.0.0/8", "Microsoft Azure"),
    ("52.0.0.0/8", "AWS/Microsoft"), ("54.0.0.0/8", "AWS"), ("35.0.0.0/8", "Google Cloud"),
    ("34.0.0.0/8", "Google Cloud"),
]
# IANA special-purpose and reserved IPv4 blocks that are never a public destination ...
NON_PUBLIC_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4",
]
# ... except these two host addresses inside 192.0.0.0/24, which are globally reachable.
PUBLIC_V4_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]

# --- fixed values: destination names and owners ---------------------------------------------
SAFE_ORGS = ["Apple Inc.", "Microsoft Corporation", "Google LLC", "NetActuate, Inc", "Cloudflare, Inc."]
SAFE_SUFFIXES = [
    "microsoft.com", "windows.com", "windowsupdate.com", "live.com", "office.com", "microsoftonline.com",
    "azure.com", "bing.com", "msn.com", "msftconnecttest.com", "msecnd.net", "google.com",
    "googleapis.com", "gstatic.com", "googleusercontent.com", "googlevideo.com", "youtube.com",
    "apple.com", "icloud.com", "mzstatic.com", "aaplimg.com", "apple", "one.one.one.one",
    "cloudflare.com", "cloudflare-dns.com", "cloudflareinsights.com", "google-analytics.com",
    "samsungelectronics.com", "dns.google", "signal.org", "fing.io", "fing.com", "sharepoint.com",
    "netflix.com", "monknow.com", "amazon.com", "amazonaws.com", "amazonvideo.com", "appcenter.ms",
    "aka.ms", "outlook.com", "microsoftpersonalcontent.com", "azureedge.net",
]
HYPERSCALER_TOKENS = [
    "amazon", "cloudflare", "google", "microsoft", "apple", "akamai", "fastly", "netflix", "facebook",
    "meta platforms", "meta-llc", "twitter", "github", "salesforce", "adobe", "oracle", "linode",
    "digitalocean", "stackpath", "bunny.net", "cdn77", "keycdn", "alibaba", "tencent", "byteplus",
    "bytedance", "ovh", "hetzner", "leaseweb", "limelight", "edgio", "cloudfront", "verizon", "at&t",
    "comcast", "level 3", "lumen", "centurylink", "incapsula", "imperva", "sucuri",
]
HYPERSCALER_SUFFIXES = [
    "microsoft.com", "live.com", "live.net", "office.com", "office.net", "microsoftonline.com",
    "sharepoint.com", "outlook.com", "msn.com", "azure.com", "azureedge.net", "windows.com",
    "windowsupdate.com", "msftconnecttest.com", "msecnd.net", "cloud.microsoft", "svc.static.microsoft",
    "public.onecdn.static.microsoft", "aka.ms", "appcenter.ms", "microsoftpersonalcontent.com",
    "google.com", "googleapis.com", "gstatic.com", "googleusercontent.com", "googlevideo.com",
    "youtube.com", "doubleclick.net", "apple.com", "icloud.com", "icloud-content.com", "mzstatic.com",
    "aaplimg.com", "cdn-apple.com", "cloudflare.com", "cloudflare-dns.com", "cloudflareinsights.com",
    "amazon.com", "amazonaws.com", "amazonvideo.com", "cloudfront.net", "akamai.net", "akamaiedge.net",
    "akamaihd.net", "edgekey.net", "fastly.net", "fastly-edge.com",
]
MULTI_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "sch.uk", "ltd.uk", "com.au", "net.au",
    "org.au", "edu.au", "gov.au", "co.nz", "net.nz", "org.nz", "co.za", "org.za", "co.jp", "ne.jp",
    "or.jp", "ac.jp", "go.jp", "com.cn", "net.cn", "org.cn", "gov.cn", "com.br", "com.mx", "com.ar",
    "com.tr", "com.pl", "com.ua", "com.vn", "com.sg", "com.hk", "com.tw", "com.my", "com.ph", "co.kr",
    "co.in", "co.il", "co.id", "co.th", "co.ke",
]
TELEMETRY_VENDORS = [  # (case-insensitive pattern, label), first match wins
    (r"baidu\.com", "Baidu"), (r"tuisong\.", "Baidu Push"), (r"snssdk\.com", "TikTok/ByteDance"),
    (r"aweme\.", "TikTok/ByteDance"), (r"bytedance\.com", "ByteDance"),
    (r"toutiao\.com", "ByteDance/Toutiao"), (r"qq\.com", "Tencent"), (r"wechat\.com", "WeChat"),
    (r"alibaba\.com", "Alibaba"), (r"aliyun\.com", "Alibaba Cloud"),
]
BENIGN_VENDORS = [  # (case-insensitive pattern, label), first match wins
    (r"microsoft|aka\.ms|msecnd\.net|msftconnecttest|appcenter\.ms|microsoftpersonalcontent\.com", "Microsoft"),
    (r"office365|sharepoint\.com|onedrive|outlook\.com", "Microsoft 365"),
    (r"trouter|asyncgw|flightproxy|teams\.", "Microsoft Teams"),
    (r"\.apple\.com$|icloud\.com|tether\.edge\.apple|\.apple$|smoot\.apple|mzstatic\.com|aaplimg\.com", "Apple"),
    (r"ubuntu\.com", "Ubuntu"),
    (r"mozilla\.(com|org|net)", "Mozilla"),
    (r"google(apis)?\.com|googleapis\.com|\.goog$|safebrowsing|dns\.google", "Google"),
    (r"^1\.1\.1\.1$|one\.one\.one\.one|cloudflare(-dns)?\.com", "Cloudflare DNS"),
    (r"^8\.8\.[48]\.8$", "Google DNS"),
    (r"nest\.com", "Google Nest"),
    (r"amazonalexa\.com", "Amazon Alexa"),
    (r"amazon\.(com|co\.uk)|amazonaws\.com|amazonvideo\.com|thumbnails-photos\.amazon", "Amazon"),
    (r"garmin\.com", "Garmin"),
    (r"fing\.(io|com)", "Fing"),
    (r"svc\.ui\.com|ubnt\.com", "Ubiquiti"),
    (r"newrelic\.com", "New Relic"),
    (r"optimizely\.com", "Optimizely"),
    (r"tailscale\.com", "Tailscale"),
    (r"signal\.org", "Signal"),
    (r"anthropic\.com", "Anthropic"),
    (r"cloudfront|azureedge\.net|fastly-edge", "CDN"),
    (r"duckduckgo\.com", "DuckDuckGo"),
    (r"monknow\.com", "Monknow"),
    (r"netflix\.com", "Netflix"),
    (r"connectivity-check", "Ubuntu connectivity"),
    (r"pgdiscovery\.com", "pgdiscovery"),
]
DEVICE_KEYWORDS = [  # (destination keywords, device label), first match wins
    (["tailscale.com", "anthropic.com"], "The Pi"),
    (["svc.ui.com", "ubnt.com"], "Ubiquiti UniFi"),
    (["logsink.devices.nest.com", "weather.nest.com"], "Nest device"),
    (["amazonalexa.com"], "Alexa device"),
    (["thumbnails-photos.amazon"], "Amazon device"),
    (["connectivity-check.ubuntu.com"], "Ubuntu machine"),
    (["garmin.com"], "Garmin device"),
    (["fing.io", "fing.com"], "Fing network scanner"),
    (["endpoint.security.microsoft", "trouter.teams.microsoft.com"], "Windows/Mac + Office 365"),
    (["icloud.com", "mask.icloud.com", "tether.edge.apple", "xp.apple.com", "smoot.apple.com"], "Apple device"),
    (["newrelic.com"], "Device with New Relic agent"),
    (["signal.org"], "Device with Signal"),
]

# --- fixed values: TLS client fingerprints --------------------------------------------------
JA4_THREAT_NEEDLES = [
    "cobalt strike", "sliver", "havoc", "qakbot", "pikabot", "darkgate", "icedid", "lumma", "ngrok",
    "mythic", "brute ratel",
]
JA4_GENERIC_RUNTIMES = ["golang"]

# --- fixed values: vendor prefixes missing from public prefix lists --------------------------
LOCAL_PREFIXES = [
    ("9C69D3", "Raspberry Pi Trading Ltd"), ("88A29E", "Raspberry Pi Trading Ltd"),
    ("D83ADD", "Raspberry Pi Trading Ltd"), ("DCA632", "Raspberry Pi Trading Ltd"),
    ("E45F01", "Raspberry Pi Trading Ltd"), ("B827EB", "Raspberry Pi Foundation"),
    ("2CCF67", "Raspberry Pi Trading Ltd"),
]

# --- fixed values: user-agent and device knowledge ------------------------------------------
WINDOWS_NT_NAMES = {
    "10.0": "Windows 10/11", "6.3": "Windows 8.1", "6.2": "Windows 8", "6.1": "Windows 7",
    "6.0": "Windows Vista", "5.1": "Windows XP",
}

# --- fixed values: scoring weights and thresholds -------------------------------------------
SCORE_WEIGHTS = {"timing": 0.25, "size": 0.25, "duration": 0.25, "histogram": 0.25}
SCORE_MIN_UNIQUE = 4
SCORE_MIN_HOURS, SCORE_IDEAL_HOURS = 6, 12
SCORE_LEVELS = {"base": 50, "low": 70, "medium": 90, "high": 100}
LONG_CONN_LEVELS = {"base": 3600, "low": 14400, "medium": 28800, "high": 43200}
C2_DNS_LEVELS = {"base": 100, "low": 500, "medium": 800, "high": 1000}
STROBE_MIN_CONNS = 250
THREAT_BYTES, THREAT_INCREASE = 25_000_000, 0.15
PREVALENCE_LOW, PREVALENCE_HIGH, PREVALENCE_STEP = 0.02, 0.5, 0.15
FIRST_SEEN_NEW_DAYS, FIRST_SEEN_OLD_DAYS, FIRST_SEEN_STEP = 7, 30, 0.15
MISSING_HOST_STEP, RARE_SIGNATURE_STEP, C2_DIRECT_STEP, MIME_MISMATCH_STEP = 0.10, 0.15, 0.15, 0.15
