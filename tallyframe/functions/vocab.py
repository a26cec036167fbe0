"""Vocabularies used by column detection and money profiling.

Fixed values that must equal the reference: keyword lists per role, generic
amount words, direction words (the Russian ones given decoded as UTF-8),
currency tokens and the date-prefix patterns. Order matters: the first
keyword that matches gives the reason text.
"""

DATE_KEYWORDS = (
    "date", "datetime", "timestamp", "time", "day", "month", "year", "period", "week", "quarter",
    "created", "created at", "updated", "updated at", "posted", "posted at", "operation date",
    "transaction date", "payment date", "invoice date", "order date", "sale date", "booking date",
    "document date", "report date", "дата", "дата операции", "дата транзакции", "дата платежа",
    "дата оплаты", "дата счета", "дата заказа", "дата продажи", "дата документа", "дата создания",
    "дата обновления", "дата проводки", "дата отчета", "время", "день", "месяц", "год", "период",
    "неделя", "квартал", "создано", "обновлено", "проведено", "күн", "күні",
)

REVENUE_KEYWORDS = (
    "revenue", "income", "sales", "sale", "turnover", "proceeds", "receipt", "receipts", "cash in",
    "cash inflow", "inflow", "incoming", "credit", "payment received", "amount received",
    "client payment", "customer payment", "gross revenue", "net revenue", "gross sales", "net sales",
    "sales amount", "revenue amount", "income amount", "выручка", "доход", "доходы", "продажи",
    "продажа", "оборот", "поступление", "поступления", "приход", "приходы", "приход денег",
    "зачисление", "зачисления", "получено", "полученная сумма", "оплата от клиента",
    "оплата клиента", "платеж клиента", "входящий платеж", "сумма дохода", "сумма выручки",
    "сумма прихода", "сумма поступления", "реализация", "валовая выручка", "чистая выручка",
    "касса приход", "кіріс", "түсім",
)

EXPENSE_KEYWORDS = (
    "expense", "expenses", "cost", "costs", "spend", "spending", "outflow", "cash out",
    "cash outflow", "debit", "withdrawal", "write off", "payment", "paid out", "supplier payment",
    "vendor payment", "purchase", "purchases", "rent", "salary", "payroll", "tax", "taxes", "fee",
    "fees", "commission", "commissions", "loss", "losses", "cogs", "operating expense",
    "expense amount", "cost amount", "расход", "расходы", "затраты", "издержки", "траты",
    "списание", "списания", "уход", "оплата", "оплаты", "выплата", "выплаты", "закуп", "закупка",
    "закупки", "аренда", "зарплата", "зп", "налог", "налоги", "комиссия", "комиссии",
    "себестоимость", "исходящий платеж", "платеж поставщику", "оплата поставщику", "сумма расхода",
    "сумма списания", "сумма затрат", "расходная часть", "минус", "шығын",
)

CATEGORY_KEYWORDS = (
    "category", "subcategory", "type", "kind", "group", "class", "tag", "label", "segment",
    "department", "project", "article", "account", "purpose", "reason", "operation type",
    "transaction type", "payment type", "cost category", "expense category", "income category",
    "revenue category", "категория", "подкатегория", "тип", "вид", "группа", "класс", "тег", "метка",
    "сегмент", "отдел", "проект", "статья", "статья расходов", "статья доходов", "счет", "назначение",
    "назначение платежа", "основание", "причина", "операция", "тип операции", "вид операции",
    "тип платежа", "категория расхода", "категория дохода", "санат", "түрі",
    "region", "product", "service", "item", "store", "shop", "branch", "location", "channel", "brand",
    "vendor", "supplier", "manager", "salesperson", "seller", "customer type", "client type",
    "payment method", "division", "unit", "source", "status", "регион", "район", "область", "город",
    "товар", "продукт", "услуга", "номенклатура", "магазин", "филиал", "точка", "склад", "направление",
    "канал", "бренд", "поставщик", "менеджер", "продавец", "клиент", "подразделение", "источник",
    "способ оплаты", "статус",
)

GENERIC_AMOUNT_KEYWORDS = (
    "amount", "sum", "total", "value", "money", "balance", "сумма", "итого", "значение", "деньги",
    "баланс",
)

AMOUNT_KEYWORDS = GENERIC_AMOUNT_KEYWORDS + (
    "transaction amount", "operation amount", "payment amount", "balance change", "net amount",
    "gross amount", "signed amount", "movement amount",
)

DIRECTION_KEYWORDS = (
    "direction", "flow", "side", "operation", "operation type", "transaction type", "income expense",
    "debit credit", "credit debit", "in out", "money flow", "cash flow", "type", "kind", "status",
    "направление", "движение", "денежный поток", "денежный поток", "тип", "вид", "операция",
    "тип операции", "приход расход", "дебет кредит", "доход расход",
)

DIRECTION_VALUE_KEYWORDS = (
    "income", "expense", "revenue", "cost", "in", "out", "inflow", "outflow", "incoming", "outgoing",
    "debit", "credit", "plus", "minus", "positive", "negative", "receipt", "payment", "withdrawal",
    "доход", "расход", "приход", "уход", "поступление", "списание", "зачисление", "выплата", "дебет",
    "кредит", "плюс", "минус",
)

CURRENCY_TOKENS = (
    "$", "€", "£", "¥", "₽", "₸", "₴", "₺", "₹", "₩", "฿", "₫", "₱", "₪", "₦",
    "usd", "eur", "gbp", "jpy", "cny", "rub", "rur", "kzt", "kgs", "uzs", "uah", "try", "inr", "krw",
    "aud", "cad", "chf", "sek", "nok", "dkk", "pln", "czk", "huf", "ron", "bgn", "gel", "amd", "azn",
    "aed", "sar", "qar", "kwd", "bhd", "omr", "ils", "egp", "zar", "brl", "mxn", "ars", "clp", "cop",
    "pen", "idr", "myr", "sgd", "thb", "vnd", "php", "hkd", "twd", "nzd", "dollar", "dollars", "euro",
    "руб", "рубль", "рублей", "тенге", "тг", "сом", "сум", "грн", "гривна",
)

# Date-looking value prefixes.
DATE_VALUE_PATTERNS = (
    r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}",
    r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}",
    r"^\d{4}-\d{1,2}-\d{1,2}[ t]\d{1,2}:\d{2}",
)

ROLE_KEYWORDS = {
    "date": DATE_KEYWORDS, "revenue": REVENUE_KEYWORDS, "expense": EXPENSE_KEYWORDS,
    "amount": AMOUNT_KEYWORDS, "category": CATEGORY_KEYWORDS,
}
