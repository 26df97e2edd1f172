"""Types of the engine's tables. Durations are whole nanoseconds; missing values read as zero values."""

from __future__ import annotations

HOP = "struct<ip:string,rtt_ns:bigint,ttl:int,anonymous:boolean,mpls:boolean>"
MEASUREMENT = f"meas_idx bigint, src string, dst string, hops array<{HOP}>, rtts_ns array<bigint>, ts timestamp, weight double"
NODES = "node_id int, label string, lat double, lon double"
LINKS = "link_id int, src int, dst int"
PATHS = "path_id bigint, src int, dst int, link_ids array<int>"
SOLUTION = "topo string, method string, link_id int, x double, confidence double, identifiable boolean"

RIPE = """array<struct<type:string,msm_id:int,prb_id:int,src_addr:string,dst_addr:string,dst_name:string,timestamp:bigint,proto:string,
result:array<struct<hop:int,result:array<struct<`from`:string,rtt:double,size:int,ttl:int,x:string,
icmpext:struct<obj:array<struct<mpls:array<struct<label:int>>>>>>>>>>>""".replace("\n", "")
SCAMPER = """struct<type:string,src:string,dst:string,start:struct<sec:bigint>,
hops:array<struct<addr:string,probe_ttl:int,rtt:double,icmpext:struct<mpls:array<struct<label:int>>>>>>""".replace("\n", "")
MTR = "struct<report:struct<mtr:struct<src:string,dst:string>,hubs:array<struct<count:int,host:string,Avg:double,Best:double,Wrst:double>>>>"
ESMOND_META = "array<struct<source:string,destination:string,`event-types`:array<struct<`event-type`:string,`base-uri`:string>>>>"
ESMOND_POINTS = "array<struct<ts:bigint,val:double>>"
INFO = "struct<id:int,description:string,type:string,status:struct<id:int,name:string>,creation_time:bigint,start_time:bigint,stop_time:bigint,is_oneoff:boolean>"
PAGE = f"struct<count:int,next:string,previous:string,results:array<{INFO}>>"
RISTAT = "struct<data:struct<asns:array<string>>>"
