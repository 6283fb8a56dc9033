"""The data model as DDL strings: findings, reports, jobs, catalogue documents and rules."""

from __future__ import annotations

FINDING = """scanner string, category string, severity string, id string, title string, description string, cvss double, package string, version string,
fixed_version string, ecosystem string, location string, cves array<string>, references array<string>, target_image string, target_name string, target_ip string, endpoint string"""
INVOCATION = """scanner string, target_image string, target_name string, target_ip string, mode string, image_ref string, started_at string, wall_seconds double,
exit_code int, status string, error string, peak_cpu_pct double, peak_mem_mb double, findings int, findings_by_severity map<string,int>, artifacts array<string>"""
TARGET = "image string, name string, ip string, weight double, meta map<string,string>"


REPORT = (
    "target struct<image:string,name:string,ip:string,weight:double,meta:map<string,string>>, started_at string, finished_at string, scanned_image_digest string, "
    "container_ip string, open_ports array<int>, http_endpoints array<string>, invocations array<struct<scanner:string,mode:string,status:string,wall_seconds:double,exit_code:int,error:string,peak_cpu_pct:double,peak_mem_mb:double,findings:int>>, "
    "findings array<struct<scanner:string,category:string,severity:string,id:string,title:string,description:string,cvss:double,package:string,version:string,fixed_version:string,ecosystem:string,location:string,cves:array<string>,references:array<string>,target_image:string,target_name:string,target_ip:string,endpoint:string>>, skipped_reason string"
)
REPOSITORY = (
    "user string, name string, namespace string, repository_type string, status int, description string, is_private boolean, is_automated boolean, star_count bigint, pull_count bigint, last_updated string, "
    "permissions struct<read:boolean,write:boolean,admin:boolean>, media_types array<string>, content_types array<string>, graph_built_at string"
)
TAG = (
    "repositories_namespace string, repositories_name string, name string, id bigint, last_updated string, full_size bigint, tag_status string, digest string, "
    "images array<struct<architecture:string,features:string,variant:string,digest:string,os:string,os_features:string,os_version:string,size:bigint,status:string,last_pulled:string,last_pushed:string>>"
)
IMAGE = ("architecture string, variant string, digest string, os string, size bigint, layers array<struct<digest:string,size:bigint,instruction:string>>")
JOB = ("id bigint, image string, name string, target_json string, weight double, status string, worker_id string, attempts int, error string, created_at double, started_at double, heartbeat_at double, finished_at double")
STORED_REPORT = ("image string, report_json string, n_findings int, finished_at double")
KEYWORD = ("_id string, status string, priority int, started_at double, finished_at double, crawled_at double")
RULE = ("name string, sensitive_type string, description string, regex string, severity string, severity_score double")
RANKING = ("repository_namespace string, repository_name string, tag_name string, image_digest string, pull_count bigint, dependency_weight bigint, downstream_pull_sum bigint, exposure bigint, weights double")

#: (name, type) of a finding's columns.
FINDING_FIELDS = [tuple(x.strip().split(" ", 1)) for x in FINDING.replace("\n", " ").split(",")]
