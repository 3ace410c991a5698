"""Word lists, patterns, limits and labels the results depend on.

Everything in this module is a constant that has to keep exactly this value for
results to be right. No logic lives here.
"""

# --- limits and policies (fixed values) -------------------------------------
MAX_FILE_BYTES = 10 * 1024 * 1024
ALLOWED_EXTENSIONS = ["png", "jpg", "jpeg", "tiff", "bmp", "webp", "pdf"]
CHUNK_CHARS = 900
CHUNK_OVERLAP = 120
PASSAGE_CHARS = 450
PASSAGE_LINES = 6
CONTEXT_CHARS = 6000
HASH_DIMENSIONS = 384
MIN_TEXT_CHARS = 80
LOW_OCR = 0.45
UNCERTAIN_CLASS = 0.70
STRONG_CLASS = 0.85
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60
CURRENCY_DECIMALS = {"TND": 3, "USD": 2, "EUR": 2}
REQUIRED_FIELDS = ["invoice_number", "date", "vendor_name", "total_amount", "currency"]
MONEY_FIELDS = ["subtotal", "tax_amount", "stamp_duty", "total_amount", "discount"]

# --- classification keywords (fixed values) ---------------------------------
STRONG_KEYWORDS = ["facture", "invoice", "avoir"]
WEAK_KEYWORDS = [
    "bill", "receipt", "total", "amount", "montant", "prix", "price", "tva", "ht", "ttc",
    "subtotal", "tax", "net a payer", "net à payer", "due date", "terms and conditions",
]
NEGATIVE_KEYWORDS = [
    "curriculum vitae", "profil", "experiences professionnelles", "expériences professionnelles",
    "formation", "langues", "competences", "compétences", "certifications",
    "projets academiques", "projets académiques", "linkedin.com",
]
TABLE_KEYWORDS = [
    "designation", "désignation", "quantite", "quantité", "prix unitaire", "pu ht", "items",
    "quantity", "price", "amount",
]
PARTY_KEYWORDS = ["buyer", "seller", "client", "customer", "fournisseur", "supplier"]
AMOUNT_LABEL_PATTERNS = [
    r"\btotal\b", r"\btotal\s+ht\b", r"\btotal\s+ttc\b", r"\bmontant\s+ht\b", r"\bmontant\s+ttc\b",
    r"\bamount\b", r"\bprice\b", r"\bsubtotal\b", r"\bnet\s+[aà]\s+payer\b", r"\btva\b", r"\btax\b",
    r"\bdiscount\b", r"\btimbre\b", r"المبلغ\s+الجملي", r"القيمة\s+المضافة", r"مجموع|الإجمالي|الاجمالي",
]
INVOICE_WORD = r"\bfactu\s*re\b|\binvoice\b|فاتورة"
INVOICE_NUMBER_HINT = r"\b(?:factu\s*re|invoice)\s*(?:id|number|no|n[°o.]*)?\s*[:#-]?\s*[a-z0-9][a-z0-9\-\/]{2,}"
FISCAL_WORD = r"\b(?:mf|matricule\s+fiscal|identifiant\s+fiscal)\b"
DATE_HINT = r"\b\d{1,2}[-\/.]\d{1,2}[-\/.]\d{2,4}\b|\b\d{1,2}-[a-z]{3}-\d{4}\b"
OTHER_TITLE = (
    r"demande\s+d['’\s]*achat|bon\s+de\s+commande|purchase\s+order|\bdevis\b|\bquotation\b|"
    r"pro\s*forma|طلب\s+شراء|عرض\s+سعر"
)
DELIVERY_TITLE = r"bon\s+de\s+livraison|delivery\s+note"

# --- retrieval queries (fixed values) ---------------------------------------
FIELD_QUERIES = {
    "invoice_number": "numero facture invoice number facture n رقم الفاتورة",
    "date": "date facture invoice date تاريخ الفاتورة",
    "due_date": "date echeance due date تاريخ الاستحقاق",
    "vendor_name": "fournisseur emetteur societe supplier name raison sociale adresse telephone email المورد",
    "vendor_address": "adresse fournisseur rue avenue supplier address عنوان المورد",
    "vendor_tax_id": "matricule fiscal fournisseur MF identifiant fiscal supplier tax id المعرف الجبائي",
    "vendor_phone": "telephone tel fournisseur supplier phone الهاتف",
    "vendor_email": "email courriel fournisseur البريد الالكتروني",
    "customer_name": "nom client societe facturee customer client الحريف العميل",
    "customer_address": "adresse client customer address عنوان الحريف",
    "customer_tax_id": "matricule fiscal client MF customer tax id المعرف الجبائي الحريف",
    "customer_phone": "telephone client customer phone هاتف الحريف",
    "subtotal": "total HT montant hors taxe sous total subtotal المبلغ دون احتساب الاداء",
    "tax_amount": "montant TVA taxe tax amount VAT الاداء على القيمة المضافة",
    "tax_rate": "taux TVA pourcentage VAT rate نسبة الاداء",
    "stamp_duty": "timbre fiscal stamp duty معلوم الطابع الجبائي",
    "total_amount": "total TTC montant toutes taxes comprises net a payer total amount المبلغ الجملي",
    "currency": "devise TND dinar EUR euro USD dollar عملة دينار",
    "payment_method": "mode paiement paye especes cheque virement comptant نقدا طريقة الدفع",
    "rib": "RIB IBAN banque compte bancaire bank account الحساب البنكي",
    "amount_in_words": "arretee presente facture somme dinars millimes montant lettres بالحروف",
    "items": "reference designation quantite prix unitaire PU HT TTC montant articles produits description quantity qty unit price item amount البيان الكمية السعر",
}
FIELD_PHRASES = {
    "invoice_number": ["facture", "numero facture", "invoice number", "n facture"],
    "date": ["date facture", "invoice date", "date"],
    "vendor_name": ["fournisseur", "supplier", "vendeur"],
    "customer_name": ["raison sociale", "client", "customer", "acheteur"],
    "subtotal": ["montant ht", "total ht", "sous total", "droits et taxes", "subtotal"],
    "tax_amount": ["tva", "tax amount", "vat"],
    "stamp_duty": ["timbre", "timbre fiscal", "stamp duty"],
    "total_amount": ["montant ttc", "total ttc", "net a payer", "total amount"],
    "payment_method": ["mode paiement", "payment method", "paiement"],
    "rib": ["rib", "iban", "banque"],
}
IMPORTANT_PHRASES = ["total ttc", "tva", "rib", "fournisseur", "client", "date facture"]
# pattern on the folded question -> terms added to the search question
CONCEPTS = [
    (r"\bttc\b|شامل.*(?:ضريب|اداء)|باحتساب.*اداء", "TTC total montant شامل الضريبة باحتساب الاداء"),
    (r"\bht\b|دون.*(?:ضريب|اداء)|خارج.*(?:ضريب|اداء)", "HT subtotal hors taxe دون الضريبة خارج الاداء"),
    (r"\btva\b|القيمة المضافة", "TVA taxe valeur ajoutee القيمة المضافة"),
    (r"fournisseur|supplier|المورد|المزود|البائع", "fournisseur supplier vendor المورد المزود البائع"),
    (r"client|customer|العميل|الحريف|المشتري", "client customer العميل الحريف المشتري"),
    (r"date|تاريخ", "date facture تاريخ الفاتورة"),
    (r"adresse|عنوان", "adresse address العنوان"),
    (r"telephone|هاتف", "telephone phone الهاتف"),
    (r"paiement|payment|دفع|خلاص", "paiement payment دفع خلاص"),
    (r"especes|نقد", "especes cash نقدا"),
    (r"matricule|fiscal|الجبائي|الضريبي", "matricule fiscal MF معرف جبائي ضريبي"),
    (r"timbre|طابع", "timbre fiscal stamp طابع جبائي"),
    (r"produit|article|designation|منتج|سلع", "produit article designation منتج سلع"),
]

# --- article table words (fixed values) -------------------------------------
FORBIDDEN_ITEM_WORDS = [
    "adresse", "address", "rue", "avenue", "route", "telephone", "tel", "fax", "email", "mail",
    "site", "web", "client", "customer", "fournisseur", "supplier", "vendeur", "seller", "facture",
    "invoice", "date", "page", "mf", "tva", "taxe", "timbre", "total", "montant", "cachet",
    "signature", "livraison", "reglement", "paiement",
]
HEADER_ITEM_WORDS = [
    "base", "taux", "code", "article", "reference", "ref", "designation", "quantite", "qte", "prix",
    "unitaire", "pu", "ht", "ttc", "montant", "total", "tva", "remise", "taxes",
]
TABLE_START = (
    r"\b(?:code\s+article|reference|r[ée]f[ée]rence|designation|d[ée]signation|quantit[ée]|qte|qt[ée]|"
    r"pu\s*(?:ht|ttc)?|prix\s+unitaire|description|quantity|qty|unit\s+price)\b"
)
TABLE_END = (
    r"\b(?:base\s+tva|total\s+tva|total\s+ttc|montant\s+ttc|montant\s+total\s+en\s+dinar|"
    r"droit\s+de\s+timbre|arr[ée]t[ée]e?\s+la\s+pr[ée]sente|cachet\s+et\s+signature|"
    r"signature\s+client|subtotal|grand\s+total)\b"
)
ITEM_UNITS = ["TONNE", "KG", "U", "UNITE", "M2", "M3"]
VAT_RATE_COLUMN = [1, 5, 7, 13, 19]

# --- aliases of JSON keys (fixed values) ------------------------------------
FIELD_ALIASES = {
    "invoice_number": ["numero_facture", "numero", "number", "invoice_number", "facture_numero", "n_facture"],
    "invoice_date": ["date_facture", "date", "invoice_date", "date_emission", "date_document"],
    "total_amount": ["total_ttc", "total", "montant_total", "total_amount", "prix_total", "somme", "montant"],
    "subtotal": ["total_ht", "sous_total", "subtotal", "montant_ht", "total_htva"],
    "tax_amount": ["tva_montant", "tva", "tax_amount", "montant_tva", "taxe"],
    "currency": ["devise", "currency", "monnaie"],
    "supplier_name": [
        "nom_entreprise", "entreprise", "nom_emetteur", "emetteur", "fournisseur", "supplier",
        "nom_organisation", "organisation",
    ],
    "customer_name": ["nom_client", "client", "beneficiaire", "destinataire", "customer"],
}
REVIEW_ALIASES = {
    "supplier": ["supplier_name", "vendor_name", "fournisseur", "raison_sociale"],
    "number": ["invoice_number", "number", "numero_facture", "num_facture"],
    "date": ["date", "invoice_date", "date_facture"],
    "due_date": ["due_date", "date_echeance", "echeance"],
    "total": ["total_amount", "total_ttc", "montant_ttc"],
    "currency": ["currency", "devise"],
}

# --- party wording (fixed values) -------------------------------------------
VENDOR_LABELS = ["fournisseur", "vendeur", "supplier", "seller", "société", "societe", "company"]
CUSTOMER_LABELS = ["client", "acheteur", "buyer", "customer", "facturé", "facturee", "facturée"]
TAX_ID_LABELS = ["mf", "matricule fiscal", "identifiant fiscal", "vat", "tax id"]
ROLE_WORDS = {
    "ship_to": r"\b(?:ship\s+to|livr[ée]\s+[aà]|destinataire\s+livraison)\b",
    "supplier": r"\b(?:fournisseur|supplier|vendor|seller|[eé]metteur)\b",
    "customer": r"\b(?:(?:nom\s+du\s+)?client|customer|bill\s+to|sold\s+to)\b",
}
ROLE_ZONE_END = (
    r"\b(?:d[ée]signation|description|quantity|quantit[ée]|items|prix\s+unitaire)\b|---\s*Page"
)
NEW_LABEL = (
    r"^(?:invoice|facture|date|due\s+date|PO\s+number|BCN|code\s*(?:client|TVA)|raison\s*sociale?|"
    r"nom\s+du\s+client|ship\s+to|bill\s+to|sold\s+to|supplier|customer|fournisseur|client|chantier|"
    r"adresse|address|t[ée]l|fax|e-?mail|GSTIN|VAT\s*ID|MF|R\.?C\.?|registre|registration|total|"
    r"sub_total|montant|TVA|FODEC|paiement|payment|net\s+[aà]\s+payer|d[ée]signation|description|"
    r"items|quantit[ée]|quantity|unit\s+price|terms|conditions|bank|banque|website|site|www\.)\b"
)

# --- numbers in text (fixed patterns) ---------------------------------------
STRICT_NUMBER = "[0-9]+(?:[ \\u00a0\\u202f][0-9]{3})*(?:[.,][0-9]+)?"
TAX_ID_SLASHED = r"\d{5,8}[A-Z]?(?:/[A-Z0-9]{1,3}){1,4}"
TAX_ID_COMPACT = r"\d{5,8}[A-Z]{1,3}\d{3}"
TAX_ID_GROUPED = r"\d{5,8}\s+[A-Z](?:\s+[A-Z0-9]{1,3}){1,4}"
