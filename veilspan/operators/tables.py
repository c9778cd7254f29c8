"""Fixed values that the operators share: weights, priorities, keywords, blacklists and mappings."""

from __future__ import annotations

# Confidence weights of detection methods, and priorities of entity types.
METHOD_WEIGHTS = {"regex": 1.2, "llm_finetuned": 1.0}
PRIORITIES = {
    "ID_CARD": 100,
    "PASSPORT": 95,
    "DRIVER_LICENSE": 90,
    "MILITARY_ID": 85,
    "SOCIAL_SECURITY": 80,
    "BANK_CARD": 75,
    "TAX_ID": 70,
    "PHONE_NUMBER": 60,
    "EMAIL": 65,
    "ADDRESS": 55,
    "POSTAL_CODE": 50,
    "PERSON_NAME": 45,
    "ORGANIZATION": 40,
    "IP_ADDRESS": 35,
    "MAC_ADDRESS": 30,
    "IMEI": 25,
    "VIN": 20,
    "VEHICLE_PLATE": 15,
}
MERGEABLE = ("ADDRESS", "ORGANIZATION", "PERSON_NAME")
LEAST_LENGTH = {"PHONE_NUMBER": 7, "ID_CARD": 15, "BANK_CARD": 13, "EMAIL": 5, "IMEI": 14}

# Words around an entity that speak for or against its type.
CONTEXT_KEYWORDS = {
    "ID_CARD": {
        "positive": ("身份证", "身份证号", "身份证号码", "证件号", "证件号码", "ID", "id", "居民身份证", "二代身份证"),
        "negative": ("价格", "金额", "数量", "编号", "序号", "货号", "订单号"),
    },
    "PASSPORT": {
        "positive": ("护照", "护照号", "护照号码", "passport", "旅行证件", "因私护照", "因公护照"),
        "negative": ("身份证", "驾驶证", "编号", "序号"),
    },
    "DRIVER_LICENSE": {
        "positive": ("驾驶证", "驾照", "驾驶证号", "驾照号码", "driver", "license", "机动车驾驶证", "准驾证"),
        "negative": ("身份证", "护照", "车牌", "车牌号"),
    },
    "MILITARY_ID": {
        "positive": ("军官证", "士兵证", "军人证", "武警证", "部队证件"),
        "negative": ("身份证", "护照", "工作证"),
    },
    "SOCIAL_SECURITY": {
        "positive": ("社保", "社保号", "社会保障号", "社保卡号", "社会保险", "社保账号", "参保号"),
        "negative": ("身份证", "银行卡", "编号"),
    },
    "BANK_CARD": {
        "positive": ("银行卡", "银行卡号", "卡号", "储蓄卡", "信用卡", "借记卡", "账号", "银行账号", "账户", "card", "bank"),
        "negative": ("身份证", "电话", "手机号", "订单号", "快递单号"),
    },
    "TAX_ID": {
        "positive": ("税号", "纳税人识别号", "税务登记号", "统一社会信用代码", "纳税识别号", "企业税号"),
        "negative": ("身份证", "银行卡", "编号"),
    },
    "PHONE_NUMBER": {
        "positive": ("电话", "手机", "电话号码", "手机号", "联系方式", "联系电话", "移动电话", "座机", "tel", "phone", "mobile", "拨打", "致电"),
        "negative": ("编号", "序号", "ID", "订单号", "快递单号", "身份证", "银行卡", "邮编", "价格"),
    },
    "EMAIL": {
        "positive": ("邮箱", "电子邮件", "电子邮箱", "email", "e-mail", "mail", "邮件地址", "联系邮箱", "发送至", "抄送", "密送"),
        "negative": ("网址", "网站", "链接", "域名"),
    },
    "ADDRESS": {
        "positive": ("地址", "住址", "家庭住址", "通讯地址", "联系地址", "收货地址", "详细地址", "所在地", "居住地", "address", "位于", "坐落于"),
        "negative": ("网址", "邮箱", "email", "链接"),
    },
    "POSTAL_CODE": {
        "positive": ("邮编", "邮政编码", "zip", "zipcode", "邮递区号", "邮区"),
        "negative": ("价格", "金额", "数量", "元", "¥", "$", "电话", "手机", "编号", "序号", "身份证"),
    },
    "PERSON_NAME": {
        "positive": ("姓名", "名字", "联系人", "先生", "女士", "老师", "经理", "主任", "总监", "name", "我是", "叫", "本人"),
        "negative": ("用户名", "账号", "昵称", "网名", "品牌", "公司", "单位"),
    },
    "ORGANIZATION": {
        "positive": ("公司", "企业", "单位", "机构", "组织", "集团", "有限公司", "股份有限", "工作单位", "就职于", "供职于", "任职于"),
        "negative": ("姓名", "人名", "先生", "女士", "个人"),
    },
    "IP_ADDRESS": {
        "positive": ("IP", "ip", "IP地址", "ip地址", "服务器", "主机", "网络地址", "内网", "外网", "公网IP", "私网IP"),
        "negative": ("版本号", "价格", "金额", "电话"),
    },
    "MAC_ADDRESS": {
        "positive": ("MAC", "mac", "MAC地址", "物理地址", "硬件地址", "网卡地址", "以太网地址"),
        "negative": ("IP", "ip", "序列号", "编号"),
    },
    "IMEI": {
        "positive": ("IMEI", "imei", "串号", "移动设备识别码", "手机串号", "设备识别码", "国际移动设备识别码"),
        "negative": ("序列号", "SN", "产品编号", "订单号"),
    },
    "VIN": {
        "positive": ("车架号", "VIN", "vin", "车辆识别代码", "车辆识别号", "底盘号", "17位码"),
        "negative": ("车牌", "车牌号", "发动机号", "序列号"),
    },
    "VEHICLE_PLATE": {
        "positive": ("车牌", "车牌号", "车号", "牌照", "号牌", "机动车号牌", "license plate", "车辆号牌"),
        "negative": ("车架号", "VIN", "发动机号", "驾驶证"),
    },
}

# Values that are never entities of their type; values are lowered before the comparison.
BLACKLIST = {
    "PERSON_NAME": ("admin", "user", "test", "guest", "root", "system", "administrator", "用户", "测试", "管理员", "访客", "张三", "李四", "王五", "赵六"),
    "EMAIL": ("noreply@", "no-reply@", "example.com", "test@", "admin@example", "user@example", "example@"),
    "PHONE_NUMBER": ("123456", "000000", "111111", "999999", "12345678", "00000000", "11111111", "1234567890", "0000000000"),
    "ORGANIZATION": ("公司", "企业", "单位", "组织", "某公司", "某企业", "XX公司"),
    "ADDRESS": ("地址", "位置", "这里", "那里"),
    "ID_CARD": ("000000000000000000", "111111111111111111"),
    "BANK_CARD": ("0000000000000000", "1111111111111111"),
}

# Characters kept at the start and the end of a masked value.
REVEALED = {"ID_CARD": (4, 4), "PHONE_NUMBER": (3, 4), "BANK_CARD": (6, 4), "EMAIL": (2, 0), "IMEI": (4, 4), "VIN": (3, 4)}
REVEALED_ELSE = (2, 2)

# Annotation tags of corpora in canonical terms.
TAGS = {"PER": "PERSON_NAME", "LOC": "ADDRESS", "ORG": "ORGANIZATION", "GPE": "ADDRESS"}
# Placeholders of masked corpora, by the first part that occurs in their name.
PLACEHOLDERS = (("NAME", "PERSON_NAME"), ("EMAIL", "EMAIL"), ("PHONE", "PHONE_NUMBER"), ("CITY|LOCATION|STREET", "ADDRESS"), ("ORG|COMPANY", "ORGANIZATION"))

# Fixed values of the heuristic detector: surnames, and the words that end addresses and organisations.
SURNAMES = (
    "王李张刘陈杨黄赵周吴"
    "徐孙马朱胡郭何高林罗"
    "郑梁谢宋唐许韩冯邓曹"
    "彭曾肖田董袁潘于蒋蔡"
    "余杜叶程苏魏吕丁任沈"
    "姚卢姜崔钟谭陆汪范金"
    "石廖贾夏韦付方白邹孟"
    "熊秦邱江尹薛闫段雷侯"
    "龙史陶黎贺顾毛郝龚邵"
    "万钱严覃武戴莫孔向汤"
)
ADDRESS_WORDS = ("省", "市", "县", "区", "镇", "乡", "村", "街道", "路", "号", "栋", "单元", "室", "楼", "层", "小区", "花园", "广场", "大厦", "中心", "园区", "工业区", "开发区")
ORGANIZATION_WORDS = (
    "公司", "集团", "企业", "有限", "股份", "科技", "实业", "贸易", "银行", "医院", "学校", "大学", "学院", "研究所", "中心", "局",
    "部", "委", "厅", "署", "队", "所", "站", "馆", "院", "社", "会", "协会", "基金会", "联盟", "组织", "机构",
)
# Patterns of the heuristic detector.
RULE_PATTERNS = {
    "PHONE_NUMBER": r"1[3-9]\d{9}",
    "ID_CARD": r"\d{17}[\dXx]",
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "BANK_CARD": r"\b\d{13,19}\b",
    "VEHICLE_PLATE": r"[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-Z][A-Z0-9]{5,6}",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "POSTAL_CODE": r"\b\d{6}\b",
    "UNIFIED_SOCIAL_CREDIT_CODE": r"[0-9A-HJ-NPQRTUWXY]{2}\d{6}[0-9A-HJ-NPQRTUWXY]{10}",
}
