"""Words that widen a question: English topics, phrases and Korean synonyms.

The tables hold fixed values: results depend on each of them. English plurals that mean the same as
their singular are found by rule and not listed.
"""

from __future__ import annotations

# Units of place and time (fixed values).
ENGLISH_UNITS = {
    "city": "시군 시군구", "county": "군 시군구", "town": "읍면동", "village": "마을 읍면동", "district": "구 읍면동",
    "region": "지역", "area": "지역", "monthly": "월별", "yearly": "연도별", "daily": "일별", "hourly": "시간별",
}

# Topics of public data (fixed values).
ENGLISH_TOPICS = {
    "elderly": "노인", "senior": "노인 경로당", "seniors": "노인", "welfare": "복지", "facility": "시설", "facilities": "시설",
    "hospital": "병원 의료기관 병의원", "clinic": "의원", "pharmacy": "약국", "pharmacies": "약국",
    "medical": "의료", "health": "보건", "child": "어린이 아동", "children": "어린이 아동", "kids": "어린이",
    "protection": "보호", "zone": "구역", "school": "학교", "cctv": "CCTV 방범", "camera": "카메라 CCTV",
    "toilet": "화장실", "toilets": "공중화장실", "restroom": "화장실", "public": "공공 공영",
    "social": "사회적", "enterprise": "기업", "company": "기업", "companies": "기업",
    "cooperative": "협동조합", "restaurant": "음식점", "restaurants": "일반음식점", "food": "음식 먹거리", "cafe": "카페",
    "price": "가격 물가 요금", "prices": "물가 가격", "cost": "요금 비용", "rice": "쌀", "pork": "돼지고기", "beef": "쇠고기",
    "cabbage": "배추", "egg": "달걀", "noodle": "냉면 칼국수", "naengmyeon": "냉면",
    "population": "인구", "resident": "주민 거주", "residents": "주민등록 인구", "living": "생활 인구", "floating": "유동 인구",
    "visitor": "방문 인구", "visitors": "방문", "foreigner": "외국인", "age": "연령", "gender": "성별",
    "household": "세대", "move-in": "전입", "move-out": "전출", "migration": "전입 전출",
    "shelter": "대피 장소 대피소", "shelters": "대피 장소", "evacuation": "대피", "disaster": "재난", "earthquake": "지진",
    "capacity": "수용 인원", "flood": "홍수 침수", "rainfall": "강우량", "weather": "기상", "air": "대기", "pollution": "오염",
    "solar": "태양광", "power": "발전", "energy": "에너지", "permit": "허가", "license": "허가 신고",
    "building": "건물", "buildings": "건물 건축물", "land": "토지", "house": "주택", "housing": "주택 공동주택",
    "property": "재산", "tax": "세 과세", "budget": "예산", "contract": "계약", "payment": "대금 지급",
    "parking": "주차장", "bus": "버스", "stop": "정류장", "route": "노선", "traffic": "교통 교통량",
    "road": "도로", "speed": "속도", "vehicle": "자동차 차량", "vehicles": "자동차", "ev": "전기차", "car": "자동차",
    "library": "도서관", "libraries": "도서관", "museum": "박물관", "culture": "문화", "cultural": "문화재",
    "heritage": "문화재", "tour": "관광", "tourism": "관광", "tourist": "관광지", "attraction": "관광지",
    "festival": "축제", "event": "행사", "exhibition": "전시", "camping": "캠핑장",
    "stay": "숙박 민박", "farm": "농어촌 농가", "farmstay": "농어촌민박", "guesthouse": "게스트하우스",
    "hotel": "호텔 숙박", "accommodation": "숙박", "sports": "체육", "sport": "체육", "gym": "체육시설", "park": "공원",
    "wifi": "와이파이", "market": "시장 전통시장", "shop": "업소", "store": "업소",
    "good-price": "착한가격", "cheap": "착한가격", "discount": "할인", "job": "취업 일자리", "jobs": "취업", "employment": "고용",
    "factory": "공장", "factories": "공장", "industry": "산업", "manufacturing": "제조", "waste": "폐기물", "sewage": "하수",
    "water": "상수도 수질", "reservoir": "저수지", "livestock": "가축 축산", "animal": "동물", "pet": "반려동물",
    "veterinary": "동물병원", "disabled": "장애인", "disability": "장애인", "youth": "청소년", "daycare": "보육 어린이집",
    "nursery": "보육", "care": "요양 돌봄", "nursing": "장기요양", "center": "센터",
    "community": "주민 마을", "office": "주민센터 행정", "funeral": "장례식장", "fire": "소방", "police": "경찰",
    "safety": "안전", "crime": "방범", "snow": "제설", "covid": "코로나", "fuel": "연료", "smoking": "금연", "tobacco": "담배",
    "news": "시정뉴스", "walking": "걷기길", "trail": "숲길 걷기길", "night": "야경", "view": "전망",
}

# English phrases and the words they add to a question (fixed values).
PHRASES = {
    "village compan": "마을기업", "social enterprise": "사회적기업",
    "child protection zone": "어린이보호구역", "child zone": "어린이보호구역",
    "public toilet": "공중화장실", "senior center": "경로당", "living population": "생활인구",
    "floating population": "유동인구", "resident population": "주민등록 인구",
    "public building": "건물재산 공공건물", "good-price shop": "착한가격업소",
    "good price shop": "착한가격업소", "farm stay": "농어촌민박", "food price": "밥상물가",
    "service price": "개인서비스요금", "sports facilit": "체육시설",
    "shelter capacity": "대피 장소 수용인원", "solar permit": "태양광발전사업 허가",
    "welfare facilit": "복지시설", "nursing home": "장기요양시설", "bus stop": "버스 정류장",
    "parking lot": "주차장", "traditional market": "전통시장", "public wifi": "공공와이파이",
    "animal hospital": "동물병원", "real estate": "부동산중개업", "land price": "개별공시지가",
    "house price": "개별주택가격",
}

# Korean words and the related words they add to a question (fixed values).
SYNONYMS = {
    "정류장": "정거장 버스", "정거장": "정류장 버스", "병원": "병의원 의료기관",
    "의료기관": "병원 병의원", "병의원": "병원 의료기관", "식당": "음식점",
    "음식점": "식당 일반음식점", "미세먼지": "대기오염 환경 pm10", "대기": "대기오염",
    "공기": "대기오염", "노인정": "경로당", "경로당": "노인 복지", "어린이집": "보육시설",
    "유치원": "보육 교육", "관광지": "관광", "숙소": "숙박", "인구": "인구 주민등록 생활인구",
    "유동인구": "유동 인구", "주차": "주차장", "화장실": "공중화장실", "시장": "전통시장",
    "공장": "제조 공장 공업", "폐기물": "폐기물 배출", "태양광": "태양광발전",
    "축제": "축제 행사", "cctv": "CCTV 방범",
    "폭염": "폭염 더위 기상 노령 인구 무더위쉼터 대피 장소",
    "더위": "폭염 기상 노령 인구 무더위쉼터 대피 장소",
    "취약": "취약 노령 인구 기상 무더위쉼터 대피 장소",
    "갈 곳": "무더위쉼터 대피 장소 경로당",
}
