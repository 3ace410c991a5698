"""Header fields of one invoice text. Every extractor is a column expression over the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billquarry import vocabulary as V
from billquarry.functions import dates, parties
from billquarry.functions import text as X
from billquarry.functions.money import AMOUNT, ocr_amount
from billquarry.operators import totals

# ordered patterns (fixed values)
NUMBER_PATTERNS = [
    r"(?=[fi])\b(?:factu\s*re|invoice)\s*(?:n[°o.]*)?\s*[:#-]?\s*([A-Z0-9][A-Z0-9\-\/]{1,})",
    r"(?=[b])\bB\.?\s*L\.?\s*-\s*Facture\s*N[°o.]?\s*([A-Z0-9\-\/]+)",
    r"(?=[n])\bN[°o.]\s*(?:de\s+facture)?\s*[:#-]?\s*([A-Z0-9][A-Z0-9\-\/]{2,})",
]
# each with a word that a text must hold
CUSTOMER_PATTERNS = [
    ("raison", r"(?=r)Raison\s+Sociale?\s*[:;]\s*([^\n\r]{2,100})"),
    ("nom", r"(?=n)Nom\s+du\s+Client\s*[:;]\s*([^\n\r]{2,100})"),
    ("client", r"(?=c)\bClient\s*[:;]\s*([^\n\r]{2,100})"),
]
CUSTOMER_ANCHOR = r"(?=[ncr])(?:Nom\s+du\s+Client|Client|Customer|Raison\s+Sociale?)\s*[:;]"
ADDRESS = r"(?=a)\b(?:Adresse|Address)[ \t]*[:\-][ \t]*([^\n\r]{5,160})"
HEADING_SKIP = r"\b(facture|date|mf|tel|fax|adresse|client|page|duplicata|original|copie)\b"
TAX_ID_IN_TEXT = r"(?=\d{5})(?:\d{5,8}\s*[A-Za-z]?(?:\s*/\s*[A-Za-z0-9]{1,3}){1,4}\b|\b\d{5,8}[A-Za-z]{1,3}\d{3}\b)"
PHONE = r"(?:\+?\d[\d ().\-]{5,}\d)"
PHONE_WORD = r"(?=[tpgm])(?:t[ée]l(?:[ée]phone)?|phone|gsm|mobile)"
CASH = r"(?=[pre])\b(?:pay[ée]e?\s+en\s+esp[èe]ces|r[èe]glement\s+en\s+esp[èe]ces|en\s+esp[èe]ces)\b"
WORDS_LEAD = [
    r"(?=a)arr[êe]t[ée]e?\s+la\s+pr[ée]sente\s+facture\s+(?:à|a)\s+la\s+somme\s+de\s*:?\s*",
    r"(?=[ms])(?:montant\s+en\s+lettres|somme\s+de)\s*:?\s*",
]
WORDS_STOP = (
    r"\b(?:retour\s+de\s+marchandises|page\s+\d+|code\s+tva|base\s+tva|total\s+tva|total\s+ttc|cachet|signature|sa\.?\s+au\s+capital|"
    r"matricule\s+fiscal)\b"
)
WORDS_AMOUNT = r"([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s'\-]+Dinar(?:\(s\)|s)?(?:\s+et\s+[A-Za-zÀ-ÿ\s'\-]+Millime(?:\(s\)|s)?)?)"
WORDS_DIRECT = r"\b([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s'\-]{2,100}?Dinars?(?:\(s\))?\s+et\s+[A-Za-zÀ-ÿ\s'\-]{2,80}?Millimes?(?:\(s\))?)\b"
# loose amounts used when no label line gives one (fixed values)
LOOSE_AMOUNTS = {
    "subtotal": r"(?:sous[- ]?total(?:\s+ht)?|subtotal|total\s+ht|montant\s+ht|droits\s+et\s+taxes)\D{0,20}([0-9][0-9 \t.,]*)",
    "stamp_duty": r"(?:timbre(?:\s+fiscal)?|stamp(?:\s+duty)?)\D{0,15}([0-9][0-9 \t.,]*)",
    "total_amount": r"(?:total\s+ttc|montant\s+ttc|net\s+à\s+payer|net\s+a\s+payer|total amount)\D{0,20}([0-9][0-9 \t.,]*)",
    "net_payable": r"(?:net\s+à\s+payer|net\s+a\s+payer|montant\s+à\s+payer|montant\s+a\s+payer)\D{0,20}([0-9][0-9 \t.,]*)",
}
# words of which a text must hold one for a loose amount
LOOSE_WORDS = {"subtotal": ["total", "montant", "droits"], "stamp_duty": ["timbre", "stamp"], "total_amount": ["total", "montant", "payer"], "net_payable": ["payer"]}


def invoice_number(text: Column) -> Column:
    def first(pattern: str) -> Column:
        cleaned = F.transform(X.grab_all(text, pattern), lambda v: F.btrim(v, F.lit(" .:-|")))
        return F.get(F.filter(cleaned, lambda v: v.rlike(r"\d")), F.lit(0))

    return F.substring(F.coalesce(*[first(p) for p in NUMBER_PATTERNS]), 1, 80)


def vendor_name(text: Column) -> Column:
    """Labelled supplier, else the first upper-case heading line of the first eight."""
    labelled = F.trim(X.grab(text, r"(?=[fs])(?:fournisseur|supplier)\s*[:\-]\s*([^\n\r]+)"))
    heads = F.slice(F.transform(totals.tidy_lines(text), lambda s: F.btrim(s, F.lit(" .:-|"))), 1, 8)
    usable = F.filter(heads, lambda s: ~s.rlike(X.IU + HEADING_SKIP) & s.rlike("[A-ZÀ-Ý]{3,}") & (F.length(s) <= 80))
    return F.coalesce(F.substring(labelled, 1, 160), F.get(usable, F.lit(0)))


def customer_name(text: Column, low: Column | None = None) -> Column:
    if low is None:
        return X.let(X.sought(text), lambda found: customer_name(text, found))
    raw = F.coalesce(*[F.when(low.contains(word), X.grab(text, p)) for word, p in CUSTOMER_PATTERNS])
    return F.substring(F.btrim(F.regexp_replace(raw, X.IU + r"\b(?:MF|TVA|ADRESSE|DATE)\b.*$", ""), F.lit(" .:-)")), 1, 120)


def party_addresses(text: Column) -> tuple[Column, Column]:
    """(vendor, customer): an address at most 280 characters after the customer label is the customer's."""
    after = F.regexp_extract(text, "(?siU)" + CUSTOMER_ANCHOR + "(.*)$", 1)
    before = F.regexp_replace(text, "(?siU)" + CUSTOMER_ANCHOR + ".*$", "")

    def clean(c: Column) -> Column:
        return X.filled(F.btrim(X.squeeze(c), F.lit(" .:-|")))

    customer = clean(X.grab(after, r"^(?s:.{0,280}?)" + ADDRESS))
    vendor = F.coalesce(clean(X.grab(before, ADDRESS)), clean(X.grab(after, r"^(?s:.{281,}?)" + ADDRESS)))
    return vendor, customer


def labelled_phones(text: Column) -> Column:
    """Phones printed after a phone word, in order."""
    return X.grab_all(text, PHONE_WORD + r"\s*[:\-]?\s*(" + PHONE + ")")


def phone(text: Column, labels: list[str], position: int, all_of: Column | None = None, low: Column | None = None) -> Column:
    """Phone on a line that names the party, else the n-th distinct labelled phone.

    ``all_of``: the text's ``labelled_phones`` where the caller has found them once for both parties.
    """
    if low is None:
        return X.let(X.sought(text), lambda found: phone(text, labels, position, all_of, found))
    all_of = labelled_phones(text) if all_of is None else all_of
    near = X.grab_all(text, "(?=[" + "".join(sorted({label[0] for label in labels})) + "])(?:" + "|".join(labels) + r")[^\n]{0,100}?" + PHONE_WORD + r"\s*[:\-]?\s*(" + PHONE + ")")
    def cleaned(tokens: Column) -> Column:
        return F.array_compact(F.transform(tokens, lambda t: F.substring(parties.clean_phone(t), 1, 40)))

    return F.coalesce(F.when(X.any_in(low, *labels), F.get(cleaned(near), F.lit(0))), F.get(F.array_distinct(cleaned(all_of)), F.lit(position)))


def tax_id_candidates(text: Column, leads: bool = True, low: Column | None = None) -> Column:
    """Identifiers of a text in order: value, lead of the vendor's words around it over the customer's, and place.

    Without ``leads`` the words around an identifier are read only where they decide whether it is one.
    """
    if low is None and leads:
        return X.let(X.sought(text), lambda found: tax_id_candidates(text, leads, found))

    def present(labels: list[str]) -> Column:
        """The labels that the text has at all: no others can stand around an identifier."""
        return F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: low.contains(n))

    marked = F.split(F.regexp_replace(text, X.IU + "(" + TAX_ID_IN_TEXT + ")", "\u0001$1\u0001"), "\u0001")

    def score(context: Column, close: Column, labels: Column) -> Column:
        return F.size(F.filter(labels, lambda n: context.contains(n))) + F.when(F.exists(labels, lambda n: close.contains(n)), 2).otherwise(0)

    def read(parts: Column, vendors: Column | None = None, customers: Column | None = None) -> Column:
        def candidate(part: Column, i: Column) -> Column:
            # identifiers are at least five characters, so 100 pieces hold more than 260 characters
            before = F.lower(X.tail(F.array_join(F.slice(parts, F.greatest(i - 99, F.lit(1)), F.least(i, F.lit(100))), ""), 260))
            after = F.lower(F.left(F.array_join(F.slice(parts, i + 2, F.lit(60)), ""), F.lit(120)))

            def scored(s: Column) -> Column:
                lead = score(s["around"], s["close"], vendors) - score(s["around"], s["close"], customers)
                usable = s["value"].contains("/") | (X.count_contained(s["around"], V.TAX_ID_LABELS) > 0)
                return F.when(s["value"].isNotNull() & usable, F.struct(s["value"].alias("value"), lead.alias("lead"), i.alias("at")))

            def alone(value: Column) -> Column:
                around = F.concat(before, F.lower(part), after)
                usable = value.contains("/") | (X.count_contained(around, V.TAX_ID_LABELS) > 0)
                return F.when(usable, F.struct(value.alias("value")))

            def contexts(s: Column) -> Column:
                return F.struct(s["value"].alias("value"), F.concat(s["before"], F.lower(part), s["after"]).alias("around"), X.tail(s["before"], 120).alias("close"))

            if not leads:
                return F.when(i % 2 == 1, X.let(parties.clean_tax_id(part), alone))
            bundle = F.struct(parties.clean_tax_id(part).alias("value"), before.alias("before"), after.alias("after"))
            return F.when(i % 2 == 1, X.let(X.let(bundle, contexts), scored))

        return F.array_compact(F.transform(parts, candidate))

    if not leads:
        return X.let(marked, read)
    return X.let(present(V.VENDOR_LABELS), lambda vendors: X.let(present(V.CUSTOMER_LABELS), lambda customers: X.let(marked, lambda parts: read(parts, vendors, customers))))


def distinct_tax_ids(text: Column) -> Column:
    """Distinct identifiers of a text in the order of their first place."""
    return F.array_distinct(F.transform(tax_id_candidates(text, leads=False), lambda c: c["value"]))


def tax_ids_by_party(text: Column, low: Column | None = None) -> Column:
    """Struct (vendor, customer): identifiers scored by the party words around them."""

    def choose(found: Column) -> Column:
        values = F.transform(found, lambda c: c["value"])
        firsts = F.filter(found, lambda c, i: F.array_position(values, c["value"]) == i + 1)

        def pick(unique: Column) -> Column:
            vendor = F.array_max(F.transform(unique, lambda c: F.struct(c["lead"].alias("lead"), (-c["at"]).alias("at"), c["value"].alias("value"))))
            customer = F.array_max(F.transform(unique, lambda c: F.struct((-c["lead"]).alias("lead"), c["at"].alias("at"), c["value"].alias("value"))))
            return F.struct(
                F.coalesce(F.when(vendor["lead"] > 0, vendor["value"]), F.get(unique, F.lit(0))["value"]).alias("vendor"),
                F.when(customer["lead"] > 0, customer["value"]).alias("customer"),
            )

        return X.let(firsts, pick)

    return X.let(tax_id_candidates(text, low=low), choose)


def cash_payment(text: Column, low: Column | None = None) -> Column:
    """First explicit cash wording, unless negated just before it."""
    low = X.sought(text) if low is None else low
    # the thirty characters before it are looked back at from where it stands
    prefix = F.regexp_extract(text, f"(?siU)(?={CASH})(?<=(^.{{0,29}}|.{{30}}))", 1)
    negated = prefix.rlike(X.IU + r"(?:non|pas(?:\s+encore)?)\s*$")
    # most texts have none, and need no look at what stands before it
    return F.when(low.contains("esp"), X.let(X.grab(text, CASH, 0), lambda found: F.when(found.isNotNull() & ~negated, found)))


def amount_in_words(text: Column, low: Column | None = None) -> Column:
    """Amount phrase after its label (three lines at most, currency words required), else a strict phrase anywhere."""

    def labelled(lead: str) -> Column:
        rest = F.regexp_extract(text, "(?siU)" + lead + "(.+)", 1)
        lines = F.slice(F.filter(F.transform(X.split_lines(rest), lambda s: F.btrim(X.squeeze(s), F.lit(" :-;\t"))), lambda s: s != ""), 1, 3)
        return F.regexp_replace(F.array_join(lines, " "), X.IU + WORDS_STOP + ".*$", "")

    def judged(candidate: Column) -> Column:
        """The phrase of a candidate, and whether it names a currency without a readable phrase."""
        found = F.btrim(X.squeeze(X.grab(candidate, WORDS_AMOUNT)), F.lit(" .:-;"))
        return X.let(
            found,
            lambda f: F.struct(
                F.when(F.length(f) >= 8, f).alias("phrase"),
                (F.coalesce(F.length(f) < 8, F.lit(True)) & candidate.rlike(X.IU + r"\b(?:Dinar|Millime)s?\b")).alias("broken"),
            ),
        )

    direct = F.filter(X.grab_all(text, WORDS_DIRECT), lambda s: ~s.rlike(X.IU + r"\b(?:montant|total|cachet|signature)\b"))
    tried = F.array(*[X.let(labelled(lead), judged) for lead in WORDS_LEAD])
    chosen = X.let(
        tried,
        lambda j: F.coalesce(
            *[F.get(j, F.lit(n))["phrase"] for n in range(len(WORDS_LEAD))],
            F.when(~F.exists(j, lambda x: x["broken"]), X.squeeze(F.get(direct, F.lit(0)))),
        ),
    )
    # without any currency word there is nothing to find
    low = X.sought(text) if low is None else low
    return F.when(low.contains("dinar"), F.substring(chosen, 1, 240))


def currency(text: Column, low: Column | None = None) -> Column:
    if low is None:
        return X.let(X.sought(text), lambda found: currency(text, found))

    def named(word: str, sign: str) -> Column:
        return F.coalesce(text.contains(sign) | (low.contains(word) & X.match(text, rf"(?={word[0]})\b{word}\b")), F.lit(False))

    return F.when(named("eur", "€"), "EUR").when(named("usd", "$"), "USD").otherwise("TND")


def wide_fields(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document with every header field; net payable decides the total, else components fill a missing one."""
    t, low = F.col(text), F.col("_low")
    seen = docs.withColumn("_low", X.sought(t)).withColumn("_marked", totals.label_lines(low)).withColumn("_phones", labelled_phones(t))
    base = seen.withColumn("_ids", tax_ids_by_party(t, low)).withColumn("_disc", totals.invoice_discount(totals.discounts(t, low)))
    for name in totals.LABELS:
        found = totals.labelled_among(F.col("_marked"), name)
        loose = ocr_amount(F.when(X.any_in(low, *LOOSE_WORDS[name]), X.grab(t, LOOSE_AMOUNTS[name]))) if name in LOOSE_AMOUNTS else None
        base = base.withColumn("_" + name, F.coalesce(found, F.when(loose > 0, loose)) if loose is not None else found)
    vendor_address, customer_address = party_addresses(t)
    zero = F.lit(0).cast(AMOUNT)
    sub, tax, stamp, total, net = (F.coalesce(F.col("_" + n), zero) for n in ("subtotal", "tax_amount", "stamp_duty", "total_amount", "net_payable"))
    discount = F.coalesce(F.col("_disc.amount"), zero)
    expected = sub - F.when(sub > discount, discount).otherwise(zero) + tax + stamp
    final = F.when(net > 0, net).when((sub > 0) & (tax > 0) & (total < sub), expected).otherwise(total)
    return base.select(
        "doc_id", *(keep or []),
        invoice_number(t).alias("invoice_number"),
        dates.printed_date(t).alias("date"),
        vendor_name(t).alias("vendor_name"),
        customer_name(t, low).alias("customer_name"),
        F.col("_ids.vendor").alias("vendor_tax_id"),
        F.col("_ids.customer").alias("customer_tax_id"),
        vendor_address.alias("vendor_address"),
        customer_address.alias("customer_address"),
        phone(t, ["fournisseur", "vendeur", "seller", "supplier"], 0, F.col("_phones"), low).alias("vendor_phone"),
        phone(t, ["client", "acheteur", "buyer", "customer"], 1, F.col("_phones"), low).alias("customer_phone"),
        F.col("_subtotal").alias("subtotal"),
        F.col("_tax_amount").alias("tax_amount"),
        F.col("_stamp_duty").alias("stamp_duty"),
        F.col("_disc.amount").alias("discount"),
        F.when(final > 0, final.cast(AMOUNT)).alias("total_amount"),
        F.col("_net_payable").alias("net_payable"),
        totals.tax_rate(t).alias("tax_rate"),
        currency(t, low).alias("currency"),
        F.coalesce(
            cash_payment(t, low), F.when(X.any_in(low, "paiement", "payment method"), F.trim(X.grab(t, r"(?=[mp])(?:mode\s+paiement|payment method)\s*[:\-]\s*([^\n\r]+)")))
        ).alias("payment_method"),
        F.when(X.any_in(low, "rib", "iban"), F.trim(X.grab(t, r"(?=[ri])(?:rib|iban)\s*[:\-]?\s*([A-Z0-9 ]+)"))).alias("rib"),
        amount_in_words(t, low).alias("amount_in_words"),
    )


def minimal_fields(text: Column) -> list[Column]:
    """Number and total only, by ordered loose patterns."""
    low = F.lower(text)
    number = F.coalesce(*[X.grab(low, p, 1, X.U) for p in (r"facture[^\d]*n°?\s*:?\s*(\d+)", r"facture[^\d]*(\d+)", r"n°\s*:?\s*(\d+)")])
    amount = F.coalesce(*[
        F.translate(X.grab(low, p, 1, X.U), ",", ".").try_cast(AMOUNT)
        for p in (r"total\s*ttc[^\d]*(\d+[,.]?\d*)", r"total[^\d]*(\d+[,.]?\d*)", r"(\d+[,.]?\d*)\s*dinars?")
    ])
    return [number.alias("invoice_number"), amount.alias("total_amount"), F.lit(0.4).alias("confidence")]


def customer_code(text: Column) -> Column:
    """Customer code on its label's line or one of the next two; only when the document has exactly one."""

    def scan(lines: Column) -> Column:
        def hit(line: Column, i: Column) -> Column:
            own = F.trim(F.regexp_extract(line, X.IU + r"^\s*(?:code\s+client|customer\s+id)\s*:?[ \t]*(.*)$", 1))
            options = F.array(own, F.trim(F.get(lines, i + 1)), F.trim(F.get(lines, i + 2)))
            good = F.filter(options, lambda o: o.rlike(X.IU + r"^[A-Z0-9/-]+$") & o.rlike(r"\d"))
            return F.when(line.rlike(X.IU + r"^\s*(?:code\s+client|customer\s+id)\b"), F.get(good, F.lit(0)))

        return F.array_compact(F.transform(lines, hit))

    return X.let(X.let(X.split_lines(text), scan), lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))))


def customer_company(text: Column) -> Column:
    """Company cell beside a customer-code label whose next line starts with a code; only when unique."""

    def scan(lines: Column) -> Column:
        def hit(line: Column, i: Column) -> Column:
            cells = F.transform(F.split(line, r"\|"), lambda c: F.trim(c))
            second = F.get(cells, F.lit(1))
            code = F.trim(F.get(F.split(F.get(lines, i + 1), r"\|"), F.lit(0)))
            roles = "|".join(V.ROLE_WORDS.values())
            usable = (
                (F.size(cells) == 2) & F.get(cells, F.lit(0)).rlike(X.IU + r"^(?:code\s+client|customer\s+code)\s*:?$")
                & ~second.rlike(X.IU + roles) & ~second.rlike(X.IU + V.NEW_LABEL)
                & second.rlike(X.IU + r"\b(?:STE|SOCI[EÉ]T[EÉ]|SARL|SUARL|EURL|LTD)\b")
                & code.rlike(X.IU + r"^[A-Z0-9][A-Z0-9./-]{3,}$") & code.rlike(r"\d")
            )
            return F.when(usable, second)

        return F.array_compact(F.transform(lines, hit))

    return X.let(X.let(X.split_lines(text), scan), lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))))


def party_block(text: Column, kind: str) -> Column:
    """Values below a party label in its own column, up to two continuation lines, stopping at a new label."""
    anchor = {
        "address": r"(?:adresse|address)\s*:\s*(.+)$",
        "customer_name": r"(?:raison\s*sociale?|nom\s+du\s+client|client|customer|bill\s+to)\s*:\s*(.+)$",
    }[kind]

    def scan(rows: Column) -> Column:
        def of_line(cells: Column, i: Column) -> Column:
            def of_cell(cell: Column, column: Column) -> Column:
                def continues(at: Column) -> Column:
                    other = F.get(rows, at)
                    piece = F.get(other, column)
                    lost = (F.size(cells) > 1) & (F.size(other) == 1)
                    plain = (piece != "") & ~piece.rlike(X.IU + V.NEW_LABEL) & ~piece.contains(":") & piece.rlike(r"^\p{L}")
                    if kind == "customer_name":
                        plain = plain & ~piece.rlike(r"\d")
                    return F.coalesce(plain & ~lost, F.lit(False))

                def stops(at: Column) -> Column:
                    return F.coalesce(F.exists(F.get(rows, at), lambda c: c.rlike(X.IU + V.NEW_LABEL)), F.lit(False))

                first = F.trim(F.regexp_extract(cell, X.IU + anchor, 1))
                second = F.when(continues(i + 1), F.get(F.get(rows, i + 1), column))
                third = F.when(second.isNotNull() & ~stops(i + 1) & continues(i + 2), F.get(F.get(rows, i + 2), column))
                return F.when(first != "", F.struct(F.concat_ws(" ", first, second, third).alias("value"), (i + 1).alias("line_start")))

            return F.transform(cells, of_cell)

        return F.array_compact(F.flatten(F.transform(rows, of_line)))

    return X.let(F.transform(X.split_lines(text), lambda s: F.transform(F.split(s, r"\|"), lambda c: F.trim(c))), scan)


def supplier_header(text: Column) -> Column:
    """Heading confirmed by the company line under it, with its identifier and address; NULL otherwise."""

    def read(lines: Column) -> Column:
        name = F.trim(F.get(F.split(F.get(lines, F.lit(0)), r"\|"), F.lit(0)))
        second = F.get(lines, F.lit(1))
        stop = F.array_min(F.transform(F.slice(lines, 1, 10), lambda s, i: F.when(s.rlike(X.IU + r"\b(?:client|facture|invoice|designation)\b"), i)))
        source = F.array_join(F.slice(lines, 1, F.coalesce(stop, F.least(F.lit(10), F.size(lines)))), "\n")
        ids = F.array_distinct(X.grab_all(source, r"\bMF\s*:\s*(\d{6,7}[A-Z](?:/[A-Z0-9]{1,3}){3})\b"))
        good = (F.length(X.compact(name)) >= 8) & second.rlike(X.IU + r"soci[ée]t[ée]|SARL|S\.A\.") & X.compact(second).contains(X.compact(name))
        return F.when(
            F.coalesce(good, F.lit(False)),
            F.struct(name.alias("vendor_name"), F.when(F.size(ids) == 1, F.get(ids, F.lit(0))).alias("vendor_tax_id"),
                     F.trim(X.grab(source, r"(?m)^S\.S\s*:\s*([^|\n]+)")).alias("vendor_address")),
        )

    return X.let(X.split_lines(text), read)


def named_contacts(name: Column, text: Column) -> Column:
    """Address, phone and email of the only line "name: address" and the contact lines under it."""
    contact_line = X.IU + r"^\s*(?:t[ée]l(?:[ée]phone)?\.?|email|e-mail|MF)\s*:"

    def read(lines: Column, key: Column) -> Column:
        def anchor(line: Column, i: Column) -> Column:
            # the address is cheaper to tell than the name
            named = line.contains(":") & line.rlike(X.IU + r"^[^:]*:\s*(?:IMM\b|immeuble\b|rue\b|avenue\b|route\b|adresse\b|\d+\s+)")
            usable = named & (X.compact(F.substring_index(line, ":", 1)) == key)
            return F.when(usable, F.struct(i.alias("i"), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)).alias("address")))

        def build(found: Column) -> Column:
            at = F.get(found, F.lit(0))["i"]
            below = F.slice(lines, at + 2, F.lit(3))
            breaks = F.array_min(F.transform(below, lambda s, j: F.when(~s.rlike(contact_line), j)))
            source = F.array_join(F.slice(below, F.lit(1), F.coalesce(breaks, F.lit(3))), "\n")
            raw = F.trim(X.grab(source, r"t[ée]l(?:[ée]phone)?\.?\s*:\s*(\+?\d[\d .()-]{6,}\d)"))
            return F.struct(
                F.get(found, F.lit(0))["address"].alias("address"), F.when(F.length(F.regexp_replace(raw, r"\D", "")).isin(8, 11), raw).alias("phone"),
                X.grab(source, r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", 0).alias("email"),
            )

        return X.let(F.array_compact(F.transform(lines, anchor)), lambda found: F.when(F.size(found) == 1, build(found)))

    # the name's letters are found once, not at every line
    return X.let(X.compact(name), lambda key: F.when(F.length(key) >= 5, X.let(X.split_lines(text), lambda lines: read(lines, key))))


# pieces of which a cell or line must hold one to be tried by the patterns of roles and of their end
_ROLE_PIECES = ("client", "fournisseur", "customer", "ship", "livr", "destinataire", "supplier", "vendor", "seller", "metteur", "bill", "sold", "raison")
_ZONE_END_PIECES = ("signation", "description", "quantit", "items", "prix", "---")


def cell_roles(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Role of every cell: the nearest party label at or above it in its column within twelve lines.

    A table or page line ends the search upwards; "raison sociale" counts as the customer. Each line looks at the twelve
    lines up to it in the document's own row.
    """
    def role_of(cell: Column) -> Column:
        role = F.lit(None).cast("string")
        for name, pattern in reversed(list(V.ROLE_WORDS.items())):
            role = F.when(cell.rlike(X.IU + pattern), F.lit(name)).otherwise(role)
        return F.coalesce(role, F.when(cell.rlike(X.IU + r"raison\s*sociale?"), F.lit("customer")))

    def cells_of(line: Column) -> Column:
        cells = F.transform(F.split(line, r"\|"), lambda c: F.trim(c))
        # most lines hold no piece of a role or of an end, which is told once for all their cells
        looks = F.struct(cells.alias("cells"), X.sought(line).alias("low"))

        def told(s: Column) -> Column:
            ends = X.any_in(s["low"], *_ZONE_END_PIECES) & line.rlike(X.IU + V.ROLE_ZONE_END)
            roles = F.when(X.any_in(s["low"], *_ROLE_PIECES), F.transform(s["cells"], role_of)).otherwise(F.array_repeat(F.lit(None).cast("string"), F.size(s["cells"])))
            return F.struct(ends.alias("end"), s["cells"].alias("cells"), roles.alias("roles"))

        return X.let(looks, told)

    def look_back(rows: Column) -> Column:
        def of_line(row: Column, i: Column) -> Column:
            above = F.slice(rows, F.greatest(i - 10, F.lit(1)), F.least(i + 1, F.lit(12)))

            def after_end(near: Column) -> Column:
                last_end = F.coalesce(F.array_max(F.transform(near, lambda r, k: F.when(r["end"], k))), F.lit(-1))
                return X.let(last_end, lambda end: F.slice(near, end + 2, F.lit(12)))

            def told(near: Column) -> Column:
                def nearest(cell: Column, c: Column) -> Column:
                    seen = F.array_compact(F.transform(near, lambda r: F.get(r["roles"], c)))
                    return F.struct(c.alias("col"), cell.alias("cell"), F.get(F.reverse(seen), F.lit(0)).alias("role"))

                return F.struct((i + 1).alias("line_id"), F.transform(row["cells"], nearest).alias("cells"))

            return X.let(X.let(above, after_end), told)

        return F.transform(rows, of_line)

    found = X.let(F.transform(X.split_lines(F.col(text)), cells_of), look_back)
    return docs.select(doc, F.inline(found)).select(doc, "line_id", F.inline("cells"))
