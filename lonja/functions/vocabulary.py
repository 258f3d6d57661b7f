"""Fixed values of the text rules: word lists and ordered patterns, lower-cased text unless stated."""

# Brand by the first pattern that a line holds, in order.
BRAND_PATTERNS = [
    ("8BitDo", r"8bitdo|8-bitdo|8 bitdo"), ("Flydigi", r"flydigi"), ("GameSir", r"gamesir"), ("Attack Shark", r"attack shark|attackshark"),
    ("Royal Kludge", r"royal kludge|rk-s\d|rk61|rk87|r65 |r75 |r87 |rk-s98|rk-s75"), ("Irok", r"\birok\b"), ("Mars", r"mars75|mars68|mars mer|iyx"), ("AJAZZ", r"\bajazz\b|ak820|ak870|ak980|ak650|mk87"),
    ("AULA", r"\baula\b|f75max|f75|f99|f108|au75"), ("ATK", r"\batk\b|atk 68|atk rs6|atk rs7|atk v75|atk v100|atk vxe"), ("MCHOSE", r"mchose|ace 68|ace68|ace 75|mix 87|mount tai|mad light"), ("VGN", r"\bvgn\b|dragonfly"),
    ("Madlions", r"\bmadlions\b|mad 60|mad 68|titan 68"), ("Razer", r"\brazer\b|deathadder|viper v\d|blackwidow|huntsman|basilisk|naga v\d|cobra pro|orochi"),
    ("Logitech", r"logitech m\d+|logitech g\d|logitech b\d|logitech pop|logitech mx|logitech lift|logitech ergo|logitech pebble"), ("KZ", r"\bkz\b|zst|zsn pro|zs10 pro|zax|asx|edx pro|zex pro|pr1 hifi|eda |zar |zna "),
    ("Polaroid", r"polaroid go|polaroid color|polaroid b&w|polaroid i-2|polaroid duochrome|polaroid sx-70"),
    ("Philips", r"philips electric shaver|philips hairclipper|philips nose|electric toothbrush|sonic toothbrush|s1125|s5366|x5001|s5831|pq888|s8850|s9935|s9642|hc\d{4}|nt\d{4}|hx\d{4}"),
    ("Haimu", r"haimu|seasalt switch|midnight blue switch|flamingo switch|ice silve switch|heartbeat switch"), ("MACHENIKE", r"machenike"), ("Akko", r"\bakko\b"), ("Keychron", r"keychron"), ("Darmoshark", r"darmoshark"),
]
# Brand by what a file name holds, in order; several words must all be there.
BRAND_FILES = [
    ("8BitDo", ["8bitdo"]), ("AJAZZ", ["ajazz"]), ("AULA", ["aula"]), ("ATK", ["atk"]), ("Attack Shark", ["attack"]), ("MCHOSE", ["mchose"]), ("MCHOSE", ["迈从"]), ("VGN", ["vgn"]), ("Madlions", ["madlions"]),
    ("Razer", ["razer"]), ("Logitech", ["logitech"]), ("Royal Kludge", ["royal kludge"]), ("Royal Kludge", ["rk", "catalog"]), ("Irok", ["irok"]), ("Irok", ["mars", "iyx"]), ("KZ", ["kz", "catalog"]),
    ("KZ", ["kz", "damulin"]), ("Polaroid", ["polaroid"]), ("Philips", ["philips"]), ("Haimu", ["keyboard switch"]), ("Flydigi", ["flydigi"]), ("GameSir", ["gamesir"]),
]
# Category of brands that make one only, and of brands as a last resort.
SINGLE_BRAND = {"Polaroid": "CAMARA", "KZ": "AURICULAR", "Haimu": "SWITCH", "Philips": "CUIDADO_PERSONAL"}
BRAND_FALLBACK = {
    "8BitDo": "CONTROLLER", "Flydigi": "CONTROLLER", "GameSir": "CONTROLLER", "Attack Shark": "MOUSE", "Madlions": "TECLADO", "MCHOSE": "TECLADO", "Royal Kludge": "TECLADO", "ATK": "TECLADO", "AULA": "TECLADO",
    "AJAZZ": "TECLADO", "Irok": "TECLADO", "Mars": "TECLADO",
}
# Category, words, confidence, in order.
CATEGORY_PATTERNS = [
    ("NUMPAD", r"numpad|numeric keypad|keypad|np20|ak33 numpad", 90),
    ("CONTROLLER", r"controller|gamepad|joystick|mando|sn30|ultimate 2c|ultimate c|ultimate 3|vader|g7 se|t4 kaleid|g8 galileo", 90),
    ("AURICULAR", r"earphone|earbuds|in-ear|iem|zst|zsn|zs10|zax|asx|edx|zex|pr1|eda|zar|zna|dqs", 90),
    ("HEADSET", r"headset|headphone|gaming headset|v9 turbo|a7v3|k7v2|a5v3|cloud ii|barracuda|kraken|blackshark|g435|g733|g335|zone wired|zone wireless", 90),
    ("MOUSEPAD", r"mousepad|mouse pad|deskmat|desk mat|playmat|tablemat|glass pad|poron pad|cordura pad|control pad|speed pad|cloth pad|glide pad|extended pad|rgb pad|custom pad|anti-slip mat|goliathus|firefly|sphex|large pad|xl pad", 90),
    ("MOUSE", r"mouse|mice|raton|paw\d{4}|aj139\w*|aj159\w*|aj199\w*|ax5\w*|a5|l7|g3|sc200|sc580|x3|r1|x11\w*|v989|f1 pro|dragonfly|f2 master|viper|deathadder|basilisk|cobra|orochi|naga|g305|g203|pebble|m100r|m90|b100|m170|m185|m220|m240|m275|m280|m310|m317|m325|m330|m500|m505|m510|m525|m650|m720|m750|mx\s*master|mx\s*anywhere|g102|g203|g304|g305|g402|g403|g502|g600|g602|g603|g604|g700|g703|g900|g903|gpro", 85),
    ("MONITOR", r"monitor|display|144hz|240hz|360hz|oled monitor", 85),
    ("CAMARA", r"webcam|camera|streamcam|brio|c920|c922|c930|kiyo|c270|c310", 85),
    ("TECLADO", r"keyboard|teclado|f75|f99|f108|k87|k68|ak820|ak870|ak980|ak680|ak650|mk87|mad\s*60|mad\s*68|titan\s*68|atk\s*68|atk\s*rs|atk\s*v|rk61|rk87|r65|r75|mars75|mars68|blackwidow|huntsman|ornata|ace\s*68|ace\s*75|mix\s*87|jet\s*75|fizz|kumara|v75x|v100pro|rs6|68rx|68\s*v3|g915|g815|g713|g613|g512|g413|g213|k845|k840|mx\s*keys|pop\s*keys|mount\s*tai", 85),
    ("SWITCH", r"key switch|mechanical switch|linear switch|tactile switch|clicky switch|seasalt switch|flamingo switch|magnetic switch|hall effect|he switch", 85),
    ("ACCESORIO", r"microphone|mic|condenser|streaming mic", 80),
    ("ACCESORIO", r"keycap|key\s*cap|wrist\s*rest|hand\s*rest|grip\s*tape|dongle|charging\s*puck|base\s*station|coiled\s*cable|digital\s*pencil|crayon|presentation\s*remote|steering\s*wheel|shifter|pedals|mouse\s*feet|skates|glides|bungee|mouse\s*bungee|light\s*strip|phone\s*cooler|cushion|pillow|almohad|backpack|power\s*supply|thunderbolt|finger\s*sleeve|studs?|head\s*cushion|lumbar", 80),
    ("SPEAKER", r"speaker|leviathan|nommo|soundbar", 85),
    ("SILLA_GAMING", r"chair|enki|iskur|fujin|gaming\s*chair", 85),
    ("ACCESORIO", r"fan|kunai|hanbo|computer\s*case|tomahawk|aio\s*cooler|cpu\s*cooler", 75),
    ("TECLADO", r"keys?\b.*\baxis|axis\b.*\bkeys?|\d+\s*keys|\baxis\b", 60),
    ("CELULAR", r"smartphone|celular|iphone|galaxy|redmi|poco x|poco f|aparelho", 85),
    ("IMPRESORA", r"printer|impresora|multifunction|multifuncional|inkjet|laserjet", 88),
    ("LAVADORA", r"washing machine|lavadora|lavarropas|washer|lavasecarropas", 88),
    ("HELADERA", r"refrigerator|fridge|heladera|freezer|congelador|refrigerador", 88),
    ("MICROONDAS", r"microwave|microondas|micro ondas", 88),
    ("AIRE", r"air conditioner|aire acondicionado|split acondicionado|acondicionado de aire", 88),
    ("ASPIRADORA", r"vacuum cleaner|aspiradora|robot vacuum|roomba|scooba", 88),
    ("CAFETERA", r"coffee maker|cafetera|espresso machine|nespresso|dolce gusto", 88),
    ("LICUADORA", r"blender|licuadora|food processor|procesadora", 85),
    ("PLANCHA", r"steam iron|plancha|vaporizador", 85),
    ("TV", r"television|smart tv|led tv|oled tv|qled tv|curved tv", 85),
]
# Short tokens that mean little, and the confidence they leave.
AMBIGUOUS_TOKENS, AMBIGUOUS_CONFIDENCE = ["a5", "l7", "g3", "x3", "r1", "mat", "a5v3"], 40
# Marketing words, nouns of products, the shape of a product code.
MARKETING = "ultra|master|star|crystal|crystalblade|gleam|glow|jade|king|queen|royal|snow|snowlight|ice|icy|cream|creamsicle|frost|horizon|nebula|nova|aurora|prism|mystic|tactical|esport|elite|premium|platinum|diamond|titan|hero|beast|legend|flagship|supreme|apex|dual|gift"
NOUNS = "dock|charger|hub|stand|soporte|pad|grip|case|cover|keyboard|teclado|keypad|numpad|keys|mouse|raton|controller|gamepad|joystick|headset|auricular|earphone|earbud|webcam|camera|camara|microphone|microfono|speaker|parlante|monitor|chair|silla|adapter|cable"
CODE = r"(?:^|[\s-])(?!paw\d)[A-Za-z]{1,6}\d{1,4}[\w+]?"
SPECS = r"(\d+(?:\.\d+)?\s*(?:mm|mn)\b)|±|\b\d+(?:\.\d+)?\s*g\b|\b(?:POM|UPE|PA12|FR4|IXPE|PET)\b|\b(?:stroke|force|material|cover|axle|working|bottoming|pre[- ]?travel)\b"
GENERIC = r"^(?:rose|zero|standard|ultimate|long|high\s+resolution|transparent|charging\s*dock|contour|contours|turbo\+?|business|new|item|product)$"
CONNECTIONS = r"\b(wired|wireless|bluetooth|2\.4g|tri[\s-]?mode|usb[\s-]?c|rgb)\b"
# Reasons of the model-quality level.
REASONS = {
    "empty": "Modelo vacío", "specs": "Modelo = specs técnicas de hoja de datos (no es un nombre de producto)", "switch": "El modelo incluye el tipo de switch/axis (debería ir aparte)",
    "truncated": "Modelo truncado (paréntesis/llave sin cerrar)", "lost_code": "El código del producto no llegó al modelo (celda fusionada/matriz)",
    "generic": "El modelo es una palabra genérica (no un código de producto) — requiere revisión", "marketing": "El modelo tiene palabras de marketing sin un identificador real de producto — requiere revisión",
    "connection": "tipo de conexión y categoría dentro del modelo", "fragment": "categoría/fragmento de especificación sin código real",
}
# Words of model classes.
TEMPLATES = r"product picture|model\s*no\.?\s*#?|technical\s+parameters?|specification|specs?\b|^image"
BARE_WORDS = ["black", "white", "grey", "gray", "purple", "violet", "red", "pink", "blue", "green", "silver", "gold", "orange", "cyan", "teal", "lavender", "rose", "yellow", "brown", "cream", "beige", "navy", "released", "new", "upcoming"]
AMBIGUOUS_WORDS = ["standard", "bill", "business"]
WATCH_WORDS = ["magnetic", "star", "starry", "ultra", "max", "extreme", "starlight", "lake", "pearl", "lemon", "lilac", "air", "pro", "plus", "lite", "mini", "classic", "retro"]
TYPE_WORDS = r"\b(mouse|keyboard|controller|headset|earphone|earbuds|numpad|mousepad|webcam|camera|microphone|switch|chair|desk|hub|adapter|cable|stand|gamepad|dock|receiver)\b"
# Words of English lists and what Spanish tariff texts say, applied one after the other.
SYNONYMS = {
    "keyboard": "teclado", "keycap": "tecla", "mouse": "indicadores apuntadores raton", "raton": "mouse", "headset": "auriculares", "earbuds": "auriculares", "headphones": "auriculares", "controller": "mando consola",
    "gamepad": "mando joystick", "joystick": "mando", "printer": "impresora", "print": "impresora", "washing": "lavadora", "washer": "lavadora", "fridge": "heladera", "refrigerator": "heladera",
    "freezer": "heladera congelador", "microwave": "microondas", "vacuum": "aspiradora", "blender": "licuadora", "coffee": "cafetera", "iron": "plancha", "smartphone": "telefono inteligente",
    "celular": "telefono inteligente smartphone", "monitor": "monitor", "television": "television", "laptop": "computadora portatil", "notebook": "computadora portatil", "tablet": "tableta", "camera": "camara",
    "webcam": "camara web", "fan": "ventilador", "air": "acondicionador aire", "conditioner": "acondicionador", "water": "agua", "heater": "calentador",
}
# Rules of fields (required, longest, pattern, least, most, whole) and known categories.
FIELD_RULES = {
    "sku": (True, 50, r"(?i)^[A-Z0-9_-]+$", None, None, False), "marca": (True, 50, None, None, None, False), "modelo": (True, 200, None, None, None, False), "cat": (True, 50, None, None, None, False),
    "fob": (True, None, None, 0.01, 5000.0, False), "qty": (True, None, None, 1.0, 9999.0, True), "color": (False, 100, None, None, None, False),
}
CATEGORIES = ["TECLADO", "MOUSE", "MOUSEPAD", "HEADSET", "AURICULAR", "CONTROLLER", "SWITCH", "CAMARA", "CUIDADO_PERSONAL", "MONITOR", "SILLA", "WEBCAM", "ACCESORIO", "OTRO"]
