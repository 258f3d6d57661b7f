"""Fixed values of degradation reasons: what warnings and gates mean, the repair for each reason, and labels."""

from __future__ import annotations

# Pattern of a warning, the reason it stands for; the first that fits counts.
WARNING_REASONS = [
    (r"sin razón atómica", "UNCLASSIFIED_YELLOW"),
    (r"el modelo incluye el tipo de switch/axis", "SWITCH_IN_MODEL"),
    (r"palabras de marketing", "MODEL_MARKETING"),
    (r"tipo de conexión y categoría", "MODEL_TYPE_GLUED"),
    (r"keyword de categoría dentro del modelo", "MODEL_TYPE_GLUED"),
    (r"modelo es solo una palabra de tipo/categoría", "MODEL_TYPE_WORD_ONLY"),
    (r"modelo es texto de plantilla", "MODEL_TEMPLATE"),
    (r"palabra genérica", "MODEL_GENERIC_WORD"),
    (r"modelo genérico sin nombre de producto", "MODEL_GENERIC_WORD"),
    (r"modelo ambiguo", "MODEL_GENERIC_WORD"),
    (r"modelo truncado", "MODEL_TRUNCATED"),
    (r"categoría/fragmento de especificación sin código real", "SPEC_FRAGMENT"),
    (r"el código del producto no llegó al modelo", "MODEL_LOST_CODE"),
    (r"color de imagen ambiguo", "COLOR_AMBIGUOUS"),
    (r"no coincide con el producto", "COLOR_MISMATCH"),
    (r"imagen ancha|imagen angosta", "ASPECT_MISMATCH"),
    (r"imagen compartida entre categorías", "SHARED_IMAGE"),
    (r"imagen compartida entre marcas", "SHARED_IMAGE"),
    (r"sin imagen de producto", "IMAGE_MISSING"),
    (r"outlier de precio", "OUTLIER_PRICE"),
    (r"categoría minoritaria", "MINORITY_CATEGORY"),
    (r"categoría dudosa", "CATEGORY_DOUBTFUL"),
    (r"precio \$\d+ fuera de rango", "PRICE_RANGE"),
    (r"fob sin evidencia literal", "FOB_NO_LITERAL_EVIDENCE"),
    (r"ancla de fila vecina", "FOB_NEIGHBOR_ANCHOR"),
    (r"ancla no alineada", "FOB_UNALIGNED"),
    (r"evidencia de grounding insuficiente", "FOB_UNGROUNDED"),
    (r"modelo = specs técnicas", "MODEL_SPECS"),
    (r"modelo vacío", "MODEL_EMPTY"),
    (r"modelo es ruido", "MODEL_GARBAGE"),
    (r"modelo es un precio numérico", "MODEL_PRICE_TOKEN"),
    (r"modelo es ruido corporativo", "MODEL_CORPORATE_NOISE"),
    (r"sku vacío|sku inválido", "SKU_INVALID"),
    (r"fob inválido", "FOB_INVALID"),
    (r"no fabrica", "BRAND_CATEGORY_MISMATCH"),
    (r"categoría no clasificada", "CATEGORY_UNCLASSIFIED"),
    (r"marca no detectada", "BRAND_MISSING"),
    (r"modelo y variante idénticos", "MODEL_VARIANT_DUPLICATE"),
    (r"variante es un precio", "VARIANT_PRICE"),
]
# What a gate of images or models found, and its reason.
GATE_REASONS = {
    "color-mismatch": "COLOR_MISMATCH",
    "category-aspect": "ASPECT_MISMATCH",
    "cross-category": "SHARED_IMAGE",
    "cross-brand": "SHARED_IMAGE",
    "generic-model": "MODEL_GENERIC_WORD",
    "ambiguous-model": "MODEL_GENERIC_WORD",
    "template-model": "MODEL_TEMPLATE",
    "truncated-model": "MODEL_TRUNCATED",
    "mid-model-type-keyword": "MODEL_TYPE_GLUED",
    "bare-type-word-model": "MODEL_TYPE_GLUED",
    "doubtful-category": "CATEGORY_DOUBTFUL",
    "placeholder-image": "IMAGE_MISSING",
}
# The repair tried for a reason.
STRATEGIES = {
    "COLOR_MISMATCH": "colorFromImage",
    "COLOR_AMBIGUOUS": "varianteColorAdoption",
    "OUTLIER_PRICE": "literalPriceRegrounding",
    "FOB_NO_LITERAL_EVIDENCE": "literalAnchorSearch",
    "FOB_UNALIGNED": "literalAnchorSearch",
    "MODEL_MARKETING": "codeAdoption",
    "MODEL_TRUNCATED": "truncationRepair",
    "SWITCH_IN_MODEL": "switchToVariante",
    "MODEL_GENERIC_WORD": "rowContextDisambiguation",
    "SPEC_FRAGMENT": "codeAdoption",
    "ASPECT_MISMATCH": "categoryCorrection",
    "SHARED_IMAGE": "sharedImageReassign",
    "LEGACY_ONLY_CLEAN": "legacyOnlyClean",
}
# A reason's label in the review report.
LABELS = {
    "COLOR_MISMATCH": "Color de imagen no coincide con el color declarado",
    "COLOR_AMBIGUOUS": "Color de imagen ambiguo (multi-color)",
    "ASPECT_MISMATCH": "Ratio de imagen incompatible con la categoría",
    "SHARED_IMAGE": "Imagen compartida entre categorías (asignación inválida)",
    "OUTLIER_PRICE": "Precio atípico (outlier IQR×3)",
    "FOB_NO_LITERAL_EVIDENCE": "FOB sin evidencia literal suficiente (ancla geométrica)",
    "FOB_NEIGHBOR_ANCHOR": "FOB anclado a fila vecina/fusionada (sin evidencia literal propia)",
    "FOB_UNALIGNED": "FOB con ancla desalineada respecto a la fila",
    "MODEL_GENERIC_WORD": "Modelo es una palabra genérica (no un código de producto)",
    "MODEL_MARKETING": "Modelo tiene palabras de marketing sin un identificador real",
    "MODEL_TRUNCATED": "Modelo truncado (paréntesis/llave sin cerrar)",
    "MODEL_TEMPLATE": "Modelo con plantilla/placeholders sin identidad real",
    "MODEL_TYPE_GLUED": "Modelo con keyword de tipo/switch pegada (specs)",
    "SWITCH_IN_MODEL": "El modelo incluye el tipo de switch/axis (debería ir aparte)",
    "SPEC_FRAGMENT": "Modelo = fragmento de especificación técnica",
    "CATEGORY_DOUBTFUL": "Categoría dudosa en la imagen",
    "IMAGE_MISSING": "Sin imagen de producto",
    "UNCLASSIFIED_YELLOW": "Degradación sin razón atómica (defecto de pipeline)",
    "LEGACY_ONLY_CLEAN": "Sin observaciones (solo warnings legacy ya resueltos)",
}
# Class of a reason that no repair removed (others: the reason in lower case).
LEFT_CLASSES = {
    "MODEL_MARKETING": "model-marketing",
    "COLOR_MISMATCH": "color-mismatch",
    "COLOR_AMBIGUOUS": "color-ambiguous",
    "OUTLIER_PRICE": "outlier-price",
    "FOB_NO_LITERAL_EVIDENCE": "fob-literal",
    "FOB_UNALIGNED": "fob-literal",
    "MODEL_TRUNCATED": "model-truncated",
    "SWITCH_IN_MODEL": "switch-in-model",
    "MODEL_GENERIC_WORD": "model-generic-word",
    "SPEC_FRAGMENT": "spec-fragment",
    "ASPECT_MISMATCH": "shared-image",
    "SHARED_IMAGE": "shared-image",
}
# Texts of rows without a reason and without a remark.
NO_REASON, NO_REMARK = "Degradación sin razón atómica", "Sin observaciones"
# Words of a price cell that are no product code, and units after a number.
CELL_NOISE = (
    r"black|white|pink|blue|red|green|purple|grey|gray|silver|gold|orange|brown|cyan|magenta|yellow|coffee|dark|light|transparent|released|new|upcoming|color|wired|wireless|bluetooth|2\.4g|usb|model|price|rmb|usd|cny"
    r"|keyboard|mouse|controller|headset|earphone|earbuds|numpad|mousepad|webcam|camera|microphone|switch|chair|desk|hub|adapter|cable|stand|gamepad|receiver|mechanical|magnetic|tri|mode|keycap|engraving|mint|side|ice|core"
    r"|total|bottoming|stroke|upper|lower|cover|material|working|force|axle|tactile|linear|clicky|actuation|travel|spring|stem|housing|factory|lubed|pom|pc|pa|upe|nylon|dustproof|dust|plate|bracket|screw"
    r"|pre[-\s]?travel|post[-\s]?travel|bottom[- ]?out|noise|silent|smooth|clack|thock|long[- ]?pole|short[- ]?pole"
)
UNITS = "mn|mm|g|n|hz|khz|mv|mah|db|ms|rpm|kg|v|w|dpi|ips|pf|f|k"
