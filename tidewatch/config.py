"""What a watch looks for and how long it remembers. Everything here can be replaced; the defaults suit municipal bulletin sites."""

from __future__ import annotations

from dataclasses import dataclass

# Word lists, patterns, extensions and limits that decide results. Order matters for KEYWORDS.
KEYWORDS = (
    "mpzp", "miejscowy plan", "plan miejscowy", "miejscowego", "miejscowy plan zagospodarowania przestrzennego",
    "projekt mpzp", "miejscowego planu zagospodarowania przestrzennego",
    "plan ogólny", "plan ogolny", "planu ogólnego",
    "studium uwarunkowań", "studium uwarunkowan",
    "warunki zabudowy", "decyzja o warunkach zabudowy", "decyzje o warunkach zabudowy",
    "decyzja środowiskowa", "decyzje środowiskowe",
    "decyzja o środowiskowych uwarunkowaniach", "środowiskowych uwarunkowaniach",
    "raport o oddziaływaniu na środowisko",
    "oze",
    "elektrownia wiatrowa", "farma wiatrowa", "wiatr", "wiatrow", "turbina",
    "fotowolta", "farma fotowoltaiczna", "magazyn energii",
)
STRICT = ("wz", "mpzp", "oze")
TRACKING = ("fbclid", "gclid", "yclid", "sid", "session", "sessionid", "phpsessid", "jsessionid", "print", "format", "lang", "locale", "language")
IGNORED_URLS = (
    "kontakt", "mapa-strony", "mapa_strony", "wyszukiwarka", "statystyka",
    "rodo", "cookies", "deklaracja-dostepnosci", "deklaracja_dostepnosci",
    "oswiadczenia", "oświadczenia", "majatk", "majątk",
    "kadra", "struktura", "regulamin", "procedur", "sygnalis",
    "login", "logowanie", "rejestracja", "newsletter", "archiwum-2",
    "galeria-zdjec", "galeria_zdjec", "multimedia", "wideo",
)
IGNORED_PATHS = (r"prognoza.pogody", r"prognoza_pogody", r"/wersja/\d+/?$")
IGNORED_ANCHORS = (
    "przejdź do menu", "przejdz do menu", "przejdź do treści", "przejdz do tresci",
    "włącz wersję kontrastową", "wlacz wersje kontrastowa",
    "drukuj", "pobierz", "pobierz dane", "xml", "rss", "start", "home", "menu",
    "zamknij", "wróć", "wroc", "cofnij", "następna strona", "poprzednia strona",
    "czytaj więcej", "czytaj wiecej", "zobacz więcej", "zobacz wiecej",
)
BAD_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".7z", ".tar", ".gz")
ATTACHMENTS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".odt", ".rtf", ".gml", ".xml", ".gpx", ".kml", ".kmz", ".geojson", ".json",
    ".shp", ".dbf", ".shx", ".prj", ".dwg", ".dxf", ".tif", ".tiff",
)
LISTING = (
    "/kategorie/", "/kategoria/", "kategoria=", "category", "/category/", "lista", "archiwum", "wszystkie", "tag", "/tag/",
    "page=", "strona=", "offset=", "start=", "limit=", "/rss", "/feed", "rss.xml", "feed.xml",
    "wyszuk", "szukaj", "search", "query=", "filter", "filtr", "ostatnio_dodane", "ostatnio_zaktualizowane",
)
SEED_HINTS = (
    "ogloszenia", "ogłoszenia", "obwieszc", "komunikat", "zawiadom", "konsultac", "wylozen", "wyłożen", "przystap", "przystąp",
    "prawo-miejscowe", "prawo_miejscowe", "uchwaly", "uchwał", "rejestr-urbanist", "rejestr_urbanist", "urbanist",
    "mpzp", "plan-ogolny", "plan_ogolny", "studium", "planowanie", "warunki-zabudowy", "warunki_zabudowy", "wz",
    "ochrona-srodowiska", "ochrona_srodowiska", "srodowisko", "środowisko", "pv", "fotowolta", "fotowoltaika", "slonecz", "słonecz",
    "oze", "energia", "energetyka", "decyzje-srodowisk", "decyzje_srodowisk", "ooś", "oos",
    "archiwum-ogloszen", "archiwum_ogloszen", "bip-archiwum", "kategoria", "kategorie", "lista-ogloszen", "lista_ogloszen",
    "decyzje", "decyzja", "postanowienie", "obwieszczenie", "srodowiskowe", "srodowiskowa", "srodowiskowych",
    "plany", "plan", "plany-zagospodarowania", "plany_zagospodarowania", "uchwala", "uchwaly", "uchwal", "uchwalone",
    "ostatnio_dodane", "ostatnio_zaktualizowane",
)
SCRIPTED_SEEDS = (
    "/rss", "/feed", "/rss.xml", "/feed.xml", "/wp-json", "/wp-json/wp/v2/posts", "/api", "/api/ogloszenia", "/api/announcements",
    "/sitemap.xml.gz", "/sitemap_index.xml.gz", "/sitemap.php", "/sitemap.xml?page=1", "/sitemap.xml?page=2",
    "/ogloszenia.xml", "/ogloszenia.rss", "/kategorie.xml", "/kategorie.rss", "/bip-sitemap.xml", "/bip-sitemap_index.xml",
    "/index.php?id=ostatnio_dodane", "/index.php?id=ostatnio_zaktualizowane", "/index.php?id=1", "/dokumenty", "/dokumenty/kategorie",
)
START_PATHS = (
    "/", "/bip/", "/BIP/", "/start", "/start.html", "/index.php", "/index.html", "/asp/start", "/asp/index.php",
    "/strona-glowna", "/strona_glowna", "/gmina", "/gmina.html", "/projekty-mpzp", "/projekty_mpzp",
    "/planowanie", "/planowanie-przestrzenne", "/dokumenty", "/prawo-miejscowe",
)
START_HINTS = ("/robots.txt", "/sitemap.xml", "/sitemap_index.xml")
PAGING_KEYS = ("page", "strona", "p", "start", "offset", "from", "limit", "per_page")
BLOCK_MARKERS = (
    "#13", "zbyt dużo jednoczesnych połączeń", "zbyt wiele jednoczesnych połączeń", "spróbuj za moment", "sprobuj za moment",
    "spróbuj ponownie później", "sprobuj ponownie pozniej", "twoja aktywność została uznana", "twoja aktywnosc zostala uznana",
    "too many requests", "request blocked", "403 forbidden", "access denied",
)
BLOCK_PHRASES = (r"\bservice unavailable\b", r"\btemporarily unavailable\b", r"\bsite is unavailable\b")
HEADING_SELECTORS = (
    "#page-title", "#pagetitle", "#content-title", "#title", ".page-title", ".entry-title", ".post-title", ".article-title",
    ".tytul", ".tytuł", ".naglowek", ".nagłowek", ".naglowekStrony", ".title", "header .title", "header .page-title",
)
SITE_WORDS = r"(biuletyn informacji publicznej|\bbip\b|gmina|urząd gminy|urzad gminy|miasto|urząd miasta|urzad miasta|starostwo|powiat|województwo|wojewodztwo)"
CATEGORY_TITLES = (
    r"^(warunki zabudowy|decyzje? (o |środowiskow|srodowiskow)|miejscowy plan|plan miejscowy|plan ogólny|plan ogolny|"
    r"studium uwarunkowań|studium uwarunkowan|mpzp|oze|farma wiatrowa|elektrownia wiatrowa|fotowolta|"
    r"obwieszczenia?|zawiadomienia?|komunikaty?|ogłoszenia?|ogloszenia?|uchwały?|uchwaly?|postanowienia?|decyzje?|"
    r"planowanie przestrzenne|zagospodarowanie przestrzenne|ochrona środowiska|ochrona srodowiska|biuletyn informacji publicznej|bip)\s*$"
)
NOISE = (
    r"wygenerowano:\s*\d{1,2}\s+[a-ząćęłńóśźż]+\s+\d{4}\s*r?\.?\s*\d{1,2}:\d{2}:\d{2}",
    r"wygenerowano:\s*\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\s+\d{1,2}:\d{2}:\d{2}",
    r"(wyświetleń|wyswietlen|odsłon|odslon|pobrań|pobran)\s*:\s*\d+",
    r"odsłony:\s*\d+",
)
TEXT_CHARS = 999_999
# End of the fixed values.


@dataclass(frozen=True)
class WatchConfig:
    keywords: tuple[str, ...] = KEYWORDS
    strict: tuple[str, ...] = STRICT
    ignored_urls: tuple[str, ...] = IGNORED_URLS
    ignored_anchors: tuple[str, ...] = IGNORED_ANCHORS
    listing: tuple[str, ...] = LISTING
    attachments: tuple[str, ...] = ATTACHMENTS
    block_markers: tuple[str, ...] = BLOCK_MARKERS
    noise: tuple[str, ...] = NOISE
    hit_hours: int = 24
    no_match_hours: int = 24
    blocked_minutes: int = 180
    failed_minutes: int = 120
    seen_days: int = 365
    seed_days: int = 30
    depth: int = 4
    start_tries: int = 16
    retries: int = 200
    seeds: int = 12_000
    sitemap_urls: int = 4_000
    discovery_pages: int = 1_000
    error_samples: int = 60
    summary_items: int = 500
    problem_reports: int = 3


DEFAULT = WatchConfig()
