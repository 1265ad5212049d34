"""Word lists, patterns and labels of the domain, as text. Values only; the rules that use them are elsewhere.

In lists of words and phrases a space stands for any white space, and ~ for optional white space. Values with anchors, numbers or other
syntax are plain regular expressions.
"""

from __future__ import annotations

import re

# ---- fixed values -------------------------------------------------------------------------------------------------------

LABELS = ["PERSON", "DRUG", "DRUG_WEIGHT", "CRIME_TIME", "CRIME_LOC", "CHARGE", "LEGAL_ARTICLE", "SENTENCE"]
LABEL_ALIASES = {"DEFENDANT": "PERSON"}
STATISTICS_ORDER = ["PERSON", "DRUG", "DRUG_WEIGHT", "CRIME_TIME", "CRIME_LOC", "CHARGE", "SENTENCE", "LEGAL_ARTICLE"]
REPORT_ORDER = ["PERSON", "CHARGE", "LEGAL_ARTICLE", "SENTENCE", "DRUG", "DRUG_WEIGHT", "CRIME_TIME", "CRIME_LOC"]
SECTION_LABELS = {
    "noi_dung": ["DRUG", "DRUG_WEIGHT", "CRIME_TIME", "CRIME_LOC"],
    "nhan_dinh": ["DRUG", "DRUG_WEIGHT", "CRIME_TIME", "CRIME_LOC"],
    "quyet_dinh": ["PERSON", "CHARGE", "LEGAL_ARTICLE", "SENTENCE"],
    "negative": [],
    "unknown": [],
}
SECTION_RANK = {"noi_dung": 0, "nhan_dinh": 1, "quyet_dinh": 2}
OTHER_SECTION_RANK = 9
SECTION_TITLES = {"noi_dung": "NỘI DUNG VỤ ÁN", "nhan_dinh": "NHẬN ĐỊNH CỦA TÒA ÁN", "quyet_dinh": "QUYẾT ĐỊNH", "unknown": "KHÔNG RÕ"}
SECTION_NAMES = {"noi_dung": "Nội dung vụ án", "nhan_dinh": "Nhận định", "quyet_dinh": "Quyết định"}
UNKNOWN_SECTION_NAME = "Không rõ"
LABEL_TITLES = {
    "PERSON": "Tên bị cáo", "CHARGE": "Tội danh", "LEGAL_ARTICLE": "Điều luật", "SENTENCE": "Hình phạt",
    "DRUG": "Loại ma túy", "DRUG_WEIGHT": "Khối lượng ma túy", "CRIME_TIME": "Thời gian phạm tội", "CRIME_LOC": "Địa điểm phạm tội",
}
NOT_FOUND = "Không tìm thấy"
PRIOR_COUNTS = {"DRUG": 519, "DRUG_WEIGHT": 152, "CRIME_TIME": 256, "CRIME_LOC": 451, "PERSON": 207, "CHARGE": 116, "LEGAL_ARTICLE": 322, "SENTENCE": 127}

# Replaced characters (removed where the second is empty), then words that were glued together.
REPLACED = {
    "\u00a0": " ", "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "", "\ufffe": " ", "\u2013": "-", "\u2014": "-",
    "\u201c": '"', "\u201d": '"', "\u2018": "'", "\u2019": "'",
}
REPLACED_ANNOTATED = REPLACED | {"\ufffd": ""}
GLUED_TRAIN = {
    "bịcáo": "bị cáo", "Tuyênbố": "Tuyên bố", "Xửphạt": "Xử phạt", "chấtma": "chất ma", "matúy": "ma túy", "ma tuý": "ma túy",
    "tàngtrữ": "tàng trữ", "tráiphép": "trái phép", "Bộluật": "Bộ luật", "Hìnhsự": "Hình sự",
}
GLUED_PREDICT = {
    "bịcáo": "bị cáo", "Bịcáo": "Bị cáo", "Tuyênbố": "Tuyên bố", "Xửphạt": "Xử phạt", "chấtma": "chất ma", "matúy": "ma túy", "ma tuý": "ma túy",
    "tàngtrữ": "tàng trữ", "tráiphép": "trái phép", "Bộluật": "Bộ luật", "Hìnhsự": "Hình sự", "Tốtụng": "Tố tụng",
}
GLUED_ANNOTATED = {"mat úy": "ma túy", "ma tuý": "ma túy", "chấtma": "chất ma", "bịcáo": "bị cáo", "Tuyênbố": "Tuyên bố", "Xửphạt": "Xử phạt"}
MOTTO = ["cộng hòa xã hội chủ nghĩa việt nam", "độc lập - tự do - hạnh phúc"]
TRIM = " \t\n\r.,;:()[]{}\"“”‘’"

# Headings, on folded text.
CONTENT_HEADS = ["NOI DUNG VU AN", "TOM TAT NOI DUNG VU AN"]
REASONING_HEADS = ["NHAN DINH CUA TOA AN", "NHAN DINH CUA HOI DONG XET XU", "HOI DONG XET XU NHAN DINH", "TOA AN NHAN DINH", "XET THAY~:"]
DECISION_HEADS = [r"^(?=[Q\s])\s*QUYET\s+DINH\s*(?::|$)"]
DECISION_OFFSET = 200
# The characters with which a match of those lists can begin.
CONTENT_FIRST, REASONING_FIRST = "NT", "NHTX"
STOPS_TRAIN_FIRST = r"NTVL(2-4\s"
DECISION_STOPS = [
    r"(?=[3-9\s])(?<![\w\d])\s*[3-9]\s*[.)]\s*(?:(?:VE\s+)?(?:XU\s+LY\s+VAT\s+CHUNG|VAT\s+CHUNG|BIEN\s+PHAP\s+TU\s+PHAP|AN\s+PHI|QUYEN\s+KHANG\s+CAO)|THONG\s+BAO\s+QUYEN\s+KHANG\s+CAO)",
    r"^\s*(?:NOI\s+NHAN\s*:|T/?M\.\s*HOI\s+DONG\s+XET\s+XU|THAM\s+PHAN|\(DA\s+KY\))", r"^-{1,}\s*(?:TAND|VKS|BI\s+CAO|LUU)",
]
DECISION_STOPS_TRAIN = [
    r"(?<![,\w\d])\s*2\.\s+(?:VE\s+)?VIEC\s+XU\s+LY\s+VAT\s+CHUNG", r"(?<![,\w\d])\s*2\.\s+XU\s+LY\s+VAT\s+CHUNG", r"(?<![,\w\d])\s*2\.\s+BIEN\s+PHAP\s+TU\s+PHAP", r"(?<![,\w\d])\s*[23]\.\s+(?:VE\s+)?AN\s+PHI",
    r"(?<![,\w\d])\s*[34]\.\s+(?:VE\s+)?QUYEN\s+KHANG\s+CAO", r"\bVE\s+VAT\s+CHUNG\s+VU\s+AN\b", r"\bTICH\s+THU\s+TIEU\s+HUY\b", r"\bTICH\s+THU\s+SUNG\s+(?:VAO\s+)?NGAN\s+SACH\b", r"TM\.\s*HOI\s+DONG\s+XET\s+XU", r"NOI\s+NHAN\s*:",
    r"THAM\s+PHAN.{0,30}CHU\s+TOA", r"\(DA\s+KY\)", r"TRUONG\s+HOP\s+BAN\s+AN\s+DUOC\s+THI\s+HANH", r"LUAT\s+THI\s+HANH\s+AN\s+DAN\s+SU",
]
TITLE_LINES = ["NỘI DUNG VỤ ÁN", "NHẬN ĐỊNH CỦA TÒA ÁN", "NHẬN ĐỊNH CỦA HỘI ĐỒNG XÉT XỬ", "XÉT THẤY", "QUYẾT ĐỊNH"]
# Headings of annotated documents: section, polarity, heading, what may follow it on its line.
ANNOTATED_HEADS = [
    ("noi_dung", "positive", r"NỘI\s+DUNG\s+VỤ\s+ÁN", r"POSITIVE|ĐOẠN\s+GÁN\s+NHÃN"),
    ("nhan_dinh", "positive", r"NHẬN\s+ĐỊNH(?:\s+CỦA\s+TÒA\s+ÁN|\s+CỦA\s+HỘI\s+ĐỒNG\s+XÉT\s+XỬ)?", r"POSITIVE|ĐOẠN\s+GÁN\s+NHÃN"),
    ("negative", "negative", r"NGỮ\s+CẢNH\s+KHÔNG\s+GÁN\s+NHÃN", "NEGATIVE"),
    ("quyet_dinh", "positive", r"QUYẾT\s+ĐỊNH", "POSITIVE"),
]
HEADING_STYLES = r"^(?:Heading\s*\d|Title|Subtitle)"
SUMMARY_OPENING = r"^NỘI\s+DUNG\s+VỤ\s+ÁN\s+Theo\s+các\s+tài\s+liệu"
BOILERPLATE = [
    r"^(?:NỘI\s+DUNG\s+VỤ\s+ÁN\s+)?Theo\s+các\s+tài\s+liệu\s+có\s+trong\s+hồ\s+sơ\s+vụ\s+án.*nội\s+dung\s+vụ\s+án\s+được\s+tóm\s+tắt\s+như\s+sau[:.]?$",
    r"^Trên\s+cơ\s+sở\s+nội\s+dung\s+vụ\s+án,\s*căn\s+cứ\s+vào\s+các\s+tài\s+liệu.*$",
    r"^Hội\s+đồng\s+xét\s+xử\s+nhận\s+định\s+như\s+sau[:.]?$",
    r"^Có\s+đủ\s+cơ\s+sở\s+kết\s+luận[:.]?$",
    r"^Có\s+đủ\s+căn\s+cứ\s+kết\s+luận[:.]?$",
    r"^Hội\s+đồng\s+xét\s+xử\s+có\s+đủ\s+cơ\s+sở\s+kết\s+luận[:.]?$",
]
TAIL_NOISE = [r"\*\s*Vật\s+chứng\s+thu\s+giữ\s*:", r"Vật\s+chứng\s+thu\s+giữ\s*:", r"Biện\s+pháp\s+tư\s+pháp\s*:", r"Về\s+vật\s+chứng\s*:"]
CONNECTORS_TRAIN = ["Khoảng", "Vào khoảng", "Vào lúc", "Hồi", "Đến khoảng", "Ngày", "Tại", "Đối với", "Trong đó"]
CONNECTORS_PREDICT = ["Khoảng", "Vào khoảng", "Vào lúc", "Hồi", "Đến khoảng", "Ngày", "Tại", "Sau đó", "Đến ngày", "Tại bản", "Tại Kết luận"]
SENTENCE_CAPITALS = "A-ZĐÁÀẢÃẠĂẮẰẶÂẤẦẬÉÈỆÊẾỀÍÌỊÓÒỌÔỐỒỘƠỚỜỢÚÙỤƯỨỪỰÝỲỴ"
SENTENCE_CAPITALS_ANNOTATED = "A-ZĐÁÀẢÃẠĂẮẰẶÂẤẦẬÉÈẸẺẼÊẾỀỆÍÌỊÓÒỌÔỐỒỘƠỚỜỢÚÙỤƯỨỪỰÝỲỴ"

# Signals of training filters.
DRUG_NAMES = [
    "methamphetamine", "metamphetamine", "metamphetamin", "methamphetamin", "methmphetamine", "amphetamine", "amphetamin", "heroine?", "ketamine", "ketamin",
    "MDMA", "MDA", "MDEA", "morphine", "morphin", "cocaine", "cocain", "codeine", "codein", "methadone", "fentanyl", "LSD", "PCP", "GHB", "psilocybin", "psilocin", "opium",
    "cannabis", "marijuana", "thuốc phiện", "a phiện", "cần sa", "cỏ mỹ", "thuốc lắc", "kẹo lắc", "ma túy kẹo", "ma~túy đá", "ma~tuý đá", "hàng đá", "hồng phiến",
    "nước vui", "happy water", "nước xoài", "nước nho", "tem giấy", "bùa lưỡi", "ma~túy khay", "hàng khay", "nấm thức thần", "thảo mộc khô",
    "ma~tuy da", "hang da", "thuoc phien", "a phien", "can sa", "co my", "thuoc lac", "keo lac", "hong phien", "nuoc vui", "nuoc xoai", "tem giay", "bua luoi", "thao moc kho",
]
WEIGHT = r"\b\d+(?:[.,]\d+)?\s*(?:gam|gram|g|kg|kilogam|miligam|milligram|mg)\b"
RANGE_AFTER = r"^\s*(?:đến|đến\s+dưới|trở\s+lên|trở\s+xuống)\b"
RANGE_CHARS = 40
CRIME_ACTIONS = [
    "phạm tội", "tàng trữ", "cất giấu", "cất giữ", "cất trên người", "mua bán", "bán trái phép", "mua .*ma túy", "mua .*ma tuý", "bán .*ma túy", "bán .*ma tuý", "vận chuyển",
    "sử dụng", "tổ chức sử dụng", "hùn tiền", "đặt mua", "giao ma túy", "giao ma tuý", "nhận ma túy", "nhận ma tuý", "giao nhận", "mang theo", "mang về", "bắt quả tang",
    "bị bắt quả tang", "kiểm tra", "phát hiện", "thu giữ", "khám xét",
]
TIME_WORDS = ["Khoảng", "Vào khoảng", "Vào lúc", "Hồi", "Đến khoảng", "Vào hồi", "Ngày", "Chiều ngày", "Tối ngày", "Sáng ngày", "Trưa ngày", "Rạng sáng", "Từ ngày"]
TIME_FORMS = [r"\b\d{1,2}\s*(?:giờ|h)\s*(?:\d{1,2}\s*phút)?\b", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"]
PLACE_WORDS = [
    "tại", "ở", "khu vực", "trước số nhà", "phòng trọ", "nhà trọ", "khách sạn", "nhà nghỉ", "quán", "đường", "phố", "thôn", "xóm", "ấp", "tổ", "khu phố", "xã", "phường",
    "thị trấn", "huyện", "quận", "thành phố", "tỉnh",
]
NOISE_OPENINGS = [
    "VE HANH VI.*QUYET DINH TO TUNG", "VE TO TUNG", "VE THU TUC", "CAC? QUYET DINH.*CO QUAN TIEN HANH", "HANH VI.*QUYET DINH.*TO TUNG", "NGUOI LAM CHUNG", "VE NGUOI LAM CHUNG",
    "VIEC VANG MAT", "VE LOI", "LOI CUA BI CAO", "VE TINH TIET TANG NANG", "VE TINH TIET.*GIAM NHE", "TINH TIET TANG NANG", "TINH TIET.*GIAM NHE", "VE NHAN THAN",
    "NHAN THAN BI CAO", "VE HINH PHAT BO SUNG", "HINH PHAT BO SUNG", "VE MUC HINH PHAT", "VE HINH PHAT(?! CHINH)", "MUC HINH PHAT", "(?:VE )?(?:XU LY )?VAT CHUNG", "(?:VE )?AN PHI",
]
NOISE_OPENING_CHARS = 120
NOISE_INSIDE = [
    "NGAY XET XU", "XET XU SO THAM", "THU LY", "CAO TRANG", "QUYET DINH DUA VU AN", "TRU SO TOA AN", "HOI TRUONG XET XU", "KIEM SAT VIEN", "LUAT SU", "NGUOI BAO CHUA", "THAM PHAN",
    "HOI THAM", "THU KY", "HKTT", "NOI CU TRU", "DIA CHI CU TRU", "CON ONG", "CON BA", "TIEN AN", "TIEN SU", "TAM GIU", "TAM GIAM", "THOI HAN TU TINH TU", "MAU NUOC TIEU",
    "NUOC TIEU", "TEST NHANH", "XET NGHIEM DUONG TINH", "TINH TIET TANG NANG", "TINH TIET GIAM NHE", "HINH PHAT BO SUNG", "HANH VI NGUY HIEM CHO XA HOI", "CHINH SACH DOC QUYEN",
    "MUC DO PHAM TOI", "AN PHI", "QUYEN KHANG CAO", "NOI NHAN", "TICH THU TIEU HUY", "TICH THU SUNG NGAN SACH", r"\bDIEU 106\b", "NGHI QUYET 326", "HOAN LAI SAU GIAM DINH",
    "CON LAI SAU GIAM DINH", "MAU VAT CON LAI", "MAU HOAN LAI",
]
MENTION_STOPS = ["NUOC TIEU", "MAU NUOC TIEU", "TEST NHANH", "XET NGHIEM DUONG TINH", "DANH MUC", "NGHI DINH", "STT", "HOAN LAI", "CON LAI SAU GIAM DINH", "MAU VAT CON LAI", "MAU HOAN LAI"]
NEGATIVE_KEEP = [
    "nơi cư trú", "địa chỉ cư trú", "chỗ ở", "hộ khẩu", "HKTT", "trú tại", "thường trú", "tạm trú", "sinh năm", "con ông", "con bà", "Tòa án nhân dân", "trụ sở Tòa án",
    "xét xử sơ thẩm", "xét xử phúc thẩm", "phiên tòa", "ngày xét xử", "thụ lý", "Viện kiểm sát", "bản cáo trạng", "cáo trạng số", "truy tố", "Cơ quan Cảnh sát điều tra",
    "Cơ quan điều tra", "Công an", "Phòng kỹ thuật hình sự", "Kết luận giám định", "kết luận giám định số", "ngày giám định", "mẫu nước tiểu", "nước tiểu", "test nhanh",
    "xét nghiệm dương tính", "hoàn lại sau giám định", "còn lại sau giám định", "mẫu vật còn lại", "mẫu hoàn lại",
]
NEGATIVE_DROP = [
    "án phí", "quyền kháng cáo", "xử lý vật chứng", "vật chứng", "tịch thu", "tiêu hủy", "sung công", "nơi nhận", "thi hành án", "Nghị quyết số~326", "Điều 106 Bộ luật Tố tụng",
]
REASONING_STOPS = [
    "Về tình tiết tăng nặng", "Về tình tiết giảm nhẹ", "Tình tiết tăng nặng", "Tình tiết giảm nhẹ", "Về nhân thân", "Về hình phạt", "Xét tính chất", "Về vật chứng",
    "Xử lý vật chứng", "Về án phí", "Về quyền kháng cáo", "Các vấn đề khác", "Vì các lẽ trên",
]
PROSECUTION = [
    "Viện kiểm sát", "Kiểm sát viên", "đại diện Viện kiểm sát", "bản cáo trạng", "cáo trạng số", "truy tố", "luận tội", "đề nghị Hội đồng xét xử", "đề nghị xử phạt",
]
FACT_CUES = [
    "có đủ căn cứ kết luận", "đủ cơ sở kết luận", "Hội đồng xét xử có đủ cơ sở kết luận", "Tòa án có đủ cơ sở kết luận", "Vào khoảng", "Vào lúc", "Hồi", "Khoảng", "bắt quả tang",
    "bị bắt quả tang", "phát hiện", "thu giữ", "tàng trữ trái phép", "mua bán trái phép", "vận chuyển trái phép", "sử dụng trái phép", "tổ chức sử dụng", "đã có hành vi",
    "hành vi nêu trên", "phạm vào tội",
]
REASONING_DROP = [
    "án phí", "vật chứng", "tịch thu", "tiêu hủy", "sung công", "quyền kháng cáo", "nơi nhận", "thi hành án", "Nghị quyết số~326", "Điều 106 Bộ luật Tố tụng",
    "tình tiết tăng nặng", "tình tiết giảm nhẹ", "thành khẩn khai báo", "ăn năn hối cải", "mức án", "hình phạt bổ sung", "miễn án phí", "buộc bị cáo phải nộp", "biết rõ",
    "gây tác hại", "nghiêm cấm", "xử lý rất nghiêm", "cần phải xử lý", "răn đe", "phòng ngừa chung", "xâm phạm", "trật tự công cộng",
]
CONCLUSIONS = ["có đủ căn cứ kết luận", "đủ cơ sở kết luận", "đã có hành vi", "hành vi nêu trên"]
REASONING_STOPS_FOLDED = ["MAU NUOC TIEU", "NUOC TIEU", "TEST NHANH", "XET NGHIEM", "DANH MUC", "NGHI DINH", "STT"]
MIN_WORDS, LONG_UNIT_TRAIN, LONG_UNIT_PREDICT, PACK_WORDS, WINDOW_WORDS = 4, 130, 140, 240, 254

# Hints of prediction filters.
DRUG_HINTS = [
    "ma~túy", "ma~tuý", "chất ma~túy", "Methamphetamine", "Heroine", "Heroin", "Ketamine", "MDMA", "Cần sa", "cần sa", "thảo mộc khô", "hồng phiến", "thuốc lắc", "nước vui",
    "ma~túy đá", "hàng khay",
]
TIME_HINTS = ["Khoảng", "Vào khoảng", "Vào lúc", "Hồi", "Đến khoảng", "Ngày", "Sáng ngày", "Trưa ngày", "Chiều ngày", "Tối ngày"]
TIME_HINT_FORMS = [r"\b\d{1,2}\s*(?:giờ|h)\b", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"]
PLACE_HINTS = [
    "tại", "ở", "khu vực", "địa chỉ", "phòng", "nhà trọ", "nhà nghỉ", "khách sạn", "quán", "đường", "phố", "thôn", "xóm", "bản", "ấp", "tổ", "khu phố", "xã", "phường", "huyện",
    "quận", "thành phố", "tỉnh", "ngã ba", "ngã tư",
]
ACTION_HINTS = [
    "mua", "bán", "giao", "nhận", "cất giấu", "cất giữ", "tàng trữ", "vận chuyển", "sử dụng", "tổ chức sử dụng", "bắt quả tang", "kiểm tra", "phát hiện", "thu giữ", "khám xét",
]
REASONING_KEEP_HINTS = ["có đủ căn cứ kết luận", "đủ cơ sở kết luận", "đã có hành vi", "hành vi nêu trên", "phạm vào tội"]
REASONING_DROP_HINTS = [
    "Viện kiểm sát", "Kiểm sát viên", "bản cáo trạng", "truy tố", "luận tội", "vật chứng", "án phí", "kháng cáo", "tình tiết tăng nặng", "tình tiết giảm nhẹ", "thành khẩn",
    "ăn năn", "hối cải", "Nghị quyết 326", "Điều 106 Bộ luật Tố tụng",
]

# Entities.
DRUG_CANON = [  # any of these inside the lower-cased name gives the canonical one; the first that fits counts
    (["methmphetamine", "methamphetamine", "metamphetamine"], "Methamphetamine"), (["=heroin", "=heroine"], "Heroine"), (["ketamine", "ketamin"], "Ketamine"), (["mdma"], "MDMA"),
    (["amphetamine"], "Amphetamine"), (["cần sa", "can sa", "thảo mộc khô", "thao moc kho"], "Cần sa"), (["hồng phiến", "hong phien"], "hồng phiến"),
    (["thuốc lắc", "thuoc lac"], "thuốc lắc"), (["nước vui", "nuoc vui"], "nước vui"), (["hàng khay", "khay"], "Ketamine"),
]
NOT_AMPHETAMINE = "meth"
CRYSTAL = ("đá", ["ma", "túy", "tuý"], "ma túy đá")
NOT_DRUGS = ["Đ", "Đ2", "D", "D1", "T", "T1", "N", "N1", "K", "H", "H2", "H3"]
NOT_DRUG_CONTEXT = ["mẫu nước tiểu", "nước tiểu", "test nhanh", "xét nghiệm", "danh mục", "nghị định", "stt"]
NOT_WEIGHT_CONTEXT = ["hoàn lại", "còn lại sau giám định", "mẫu hoàn", "mẫu vật còn lại"]
ENTITY_WEIGHT = r"\b\d+(?:[.,]\d+)?\s*(?:gam|g|mg|kg|gram|miligam|milligram)\b"
NOT_ARTICLES = [
    "Điều 32", "Điều 47", "Điều 106", "Điều 135", "Điều 136", "Điều 298", "Điều 331", "Điều 333", "Nghị quyết 326", "Bộ luật Tố tụng", "án phí", "vật chứng",
]
PERSON_ENDS = ["phạm", "về", "bị", "xử", "phải", "chịu", "chấp", "từ", "đến"]
NOT_FIRST_NAMES = ["Tòa", "Viện", "Hội", "Điều", "Bộ", "Căn", "Xử", "Tuyên", "Buộc", "Không", "Miễn", "Tịch", "Trả", "Thời", "Kể"]
ENTITY_TIMES = [
    r"\d{1,2}\s*(?:giờ|h)", r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}", "Khoảng", r"Vào\s+khoảng", "Hồi", r"Đến\s+khoảng", r"Sáng\s+ngày", r"Trưa\s+ngày",
    r"Chiều\s+ngày", r"Tối\s+ngày",
]
NOT_TIME_CONTEXT = ["kết luận giám định", "cáo trạng", "quyết định đưa vụ án", "ngày xét xử", "thụ lý", "mẫu nước tiểu", "xét nghiệm"]
ACT_CONTEXT = ["mua", "bán", "giao", "nhận", "sử dụng", "cất giấu", "tàng trữ", "vận chuyển", "bắt quả tang", "kiểm tra", "thu giữ"]
VAGUE_PLACES = [
    "tại đây", "ở đây", "khu vực này", "khu vực trên", "khu vực nêu trên", "địa điểm trên", "nơi trên", "chỗ đó", "chỗ này", "trên đường",
]
BARE_PLACE = r"^(?:xã|phường|huyện|quận|tỉnh|thành\s+phố)\s+[A-ZĐa-zÀ-ỹ0-9]+$"
CLEAR_PLACES = [
    r"số [A-Z0-9/.-]+", r"phòng \w+", r"nhà trọ\b", r"nhà nghỉ\b", r"khách sạn\b", r"quán\b", r"chợ\b", r"đường\b", r"phố\b", r"ngõ\b", r"ngách\b", r"hẻm\b", r"thôn\b", r"xóm\b",
    r"bản\b", r"ấp\b", r"tổ dân phố\b", r"khu phố\b", r"khóm\b", r"ngã ba\b", r"ngã tư\b", r"chung cư\b", r"khu đô thị\b", r"cổng\b", r"bến xe\b", r"nghĩa trang\b", r"cửa khẩu\b",
]
ADMIN_WORDS = ["xã", "phường", "thị trấn", "huyện", "quận", "thành phố", "tỉnh"]
NOT_PLACE_CONTEXT = ["nơi thường trú", "hktt", "trú tại", "trụ sở tòa án", "viện kiểm sát", "tòa án nhân dân"]
FINE = r"(?:phạt\s+tiền|phạt\s+bổ\s+sung).*\d{1,3}(?:\.\d{3})+\s*đồng"
CHARGE_OBJECT = "chất ma túy"
CONTEXT_CHARS = 500

# Rules for the decision section: label, rule, expression, group that is the entity, a word in lower case that every match holds.
NAME_PART = "(?:[A-ZĐ][a-zàáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ]+|[A-ZĐ])"
RULES = [
    ("PERSON", "decision_person", rf"\bbị\s+cáo\s+({NAME_PART}(?:\s+{NAME_PART}){{1,5}})", 1, "cáo"),
    ("PERSON", "decision_person", rf"(?:Tuyên\s+bố|Xử\s+phạt|Buộc)\s+(?:bị\s+cáo\s+)?({NAME_PART}(?:\s+{NAME_PART}){{1,5}})", 1, None),
    ("CHARGE", "decision_charge", r"(?:Tàng\s+trữ|Mua\s+bán|Vận\s+chuyển|Tổ\s+chức\s+sử\s+dụng|Sử\s+dụng)\s+trái\s+phép\s+chất\s+ma\s+túy", 0, "phép"),
    ("LEGAL_ARTICLE", "decision_legal_article", r"\bđiểm\s+[a-z]\s+khoản\s+\d+\s+Điều\s+\d+[a-z]?\b", 0, "điểm"),
    ("LEGAL_ARTICLE", "decision_legal_article", r"\bkhoản\s+\d+\s+Điều\s+\d+[a-z]?\b", 0, "khoản"),
    ("LEGAL_ARTICLE", "decision_legal_article", r"\bĐiều\s+\d+[a-z]?\b", 0, "điều"),
    ("SENTENCE", "decision_sentence", r"(?:Xử\s+phạt|phạt)\s+(?:bị\s+cáo\s+)?[A-ZĐ][^.;:\n]{0,90}?\s+(?:\d{1,2}|[a-zà-ỹ\s]+)\s*(?:\([^)]*\)\s*)?(?:năm|tháng)\s+(?:\d{1,2}\s*(?:\([^)]*\)\s*)?tháng\s+)?tù", 0, "tù"),
    ("SENTENCE", "decision_sentence", r"\b\d{1,2}\s*(?:\([^)]*\)\s*)?năm(?:\s+\d{1,2}\s*(?:\([^)]*\)\s*)?tháng)?\s+tù\b", 0, "tù"),
    ("SENTENCE", "decision_sentence", r"\b\d{1,2}\s*(?:\([^)]*\)\s*)?tháng\s+tù\b", 0, "tù"),
    ("SENTENCE", "decision_sentence", r"phạt\s+(?:bổ\s+sung\s+)?(?:bị\s+cáo\s+)?[A-ZĐ][^.;:\n]{0,80}?\s+\d{1,3}(?:\.\d{3})+\s*đồng", 0, "đồng"),
    ("SENTENCE", "decision_sentence", r"phạt\s+tiền\s+\d{1,3}(?:\.\d{3})+\s*đồng", 0, "đồng"),
]

# Relations: type, label, label of the partner, how many places ahead.
PERSON_RELATIONS = [("PERSON_HAS_SENTENCE", "SENTENCE", 11), ("PERSON_HAS_CHARGE", "CHARGE", 13)]
WEIGHT_RELATION, WEIGHT_REACH = "DRUG_HAS_WEIGHT", 4

# ---- end of fixed values ------------------------------------------------------------------------------------------------

FLAGS = "(?iuU)"


def pattern(phrase: str) -> str:
    """The regular expression of a phrase, without flags."""
    return phrase.replace("~", r"\s*").replace(" ", r"\s+")


def _grouped(phrases: list[str], fold: bool) -> str:
    """The phrases as alternatives, those with the same letters in front under one branch: at each place most are passed over at once.

    Of phrases that begin alike the earlier one still wins. Those that don't begin with a plain letter stay whole.
    """
    groups: dict[str, list[str]] = {}
    for p in phrases:
        plain = p[:1].isalpha() and p[1:2] not in ("?", "*", "+", "{", "~") and "|" not in re.sub(r"\([^()]*\)", "", p)
        groups.setdefault((p[0].lower() if fold else p[0]) if plain else f"={p}", []).append(p)
    branch = lambda key, g: pattern(g[0]) if len(g) == 1 or key[0] == "=" else pattern(g[0][0]) + f"(?:{_grouped([p[1:] for p in g], fold)})"
    return "|".join(branch(key, g) for key, g in groups.items())


def any_of(phrases: list[str], words: bool = False, lines: bool = False, flags: str = FLAGS, first: str | None = None) -> str:
    """One expression for all phrases; words: at word borders on both sides; lines: ^ and $ at every line.

    first: the characters with which a match can begin, as inside brackets; at others no phrase is tried.
    """
    inner = _grouped(phrases, "i" in flags)
    if first:
        inner = f"(?=[{first}])(?:{inner})"
    return f"{flags}{'(?m)' if lines else ''}" + (rf"\b(?:{inner})\b" if words else f"(?:{inner})")
