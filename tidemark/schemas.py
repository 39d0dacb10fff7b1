"""Schemas of the wire records, declared once, as DDL texts (these need no session)."""

from __future__ import annotations

PRODUCT = ("productId string, name string, description string, price double, category string, brand string, imageUrl string, inventory int, tags array<string>, rating double, reviewCount int")
SHOPPING_EVENT = (
    "eventId string, sessionId string, userId string, eventType string, timestamp bigint, productId string, categoryId string, value double, quantity int, searchQuery string, "
    "metadata map<string,string>, referrer string, userAgent string, ipAddress string, page string, title string, productName string, resultCount int, recommendationId string"
)
ORDER_ITEM = ("orderId string, productId string, quantity int, timestamp bigint")
PATTERN = ("antecedents array<string>, consequent string, support double, confidence double, lift double, timestamp bigint, userId string, sessionId string, category string")
CDC = ("op string, source struct<table:string>, before string, after string")
CART_ITEM = ("productId string, productName string, price double, quantity int, subtotal double, imageUrl string, addedAt bigint")
INVENTORY_EVENT = ("productId string, productName string, eventType string, previousInventory int, currentInventory int, previousPrice double, currentPrice double, timestamp bigint, changeReason string, alertLevel string")
ALERT = ("alertType string, productId string, message string, severity string, timestamp bigint")
RAW_CHAT = ("userId string, toUserId string, type string, message string, timestamp bigint, preferredLanguage string, languages array<string>")
ASSISTANT_CHAT = ("messageId string, sessionId string, userId string, text string, timestamp bigint, type string")
RECOMMENDATION = ("recommendationId string, userId string, sessionId string, recommendedProducts array<string>, recommendationType string, confidence double, timestamp bigint")
PURCHASE = ("userId string, sessionId string, items array<string>, totalValue double, basketSize int, userPurchaseHistory int, timestamp bigint")
POINT = ("value int, timestamp bigint")
VEHICLE = (
    "VP struct<desi:string,dir:string,oper:int,veh:int,tst:string,tsi:bigint,spd:double,hdg:int,lat:double,long:double,acc:double,dl:int,odo:double,drst:int,oday:string,jrn:int,line:int,start:string,loc:string,stop:string,route:string,occu:int>"
)
STORED_PATTERN = ("pattern_id string, antecedents array<string>, consequent string, support double, confidence double, lift double, category string, user_id string, session_id string, created_at timestamp, event_time timestamp")
