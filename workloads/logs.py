"""The raw logs and events the registered queries run on."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from vigilake import configure
from vigilake.sources.auth import auth_events
from vigilake.sources.delimited import csv_events
from vigilake.sources.json_docs import json_document_events, json_line_events
from vigilake.sources.web import web_events
from vigilake.sources.windows import win_block_events, win_tabular_events
from vigilake.sources.xml_docs import xml_record_events
from workloads import views

YEAR = 2024


class Logs:
    """Raw lines per log kind, derived from the tables, and the events parsed from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    def raw(self, view: str) -> DataFrame:
        return getattr(views, view)(self.spark, self.sf_dir)

    @cached_property
    def auth(self) -> DataFrame:
        return auth_events(self.raw("auth_lines"), YEAR)

    @cached_property
    def generic(self) -> DataFrame:
        return auth_events(self.raw("auth_lines"), YEAR, "generic")

    @cached_property
    def web(self) -> DataFrame:
        return web_events(self.raw("web_lines"))

    @cached_property
    def win(self) -> DataFrame:
        return win_tabular_events(self.raw("win_lines"))

    @cached_property
    def blocks(self) -> DataFrame:
        return win_block_events(self.raw("win_blocks"))

    @cached_property
    def csv(self) -> DataFrame:
        return csv_events(self.raw("firewall_lines"))

    @cached_property
    def cloud(self) -> DataFrame:
        return json_line_events(self.raw("cloud_lines"))

    @cached_property
    def documents(self) -> DataFrame:
        return json_document_events(self.raw("cloud_documents"))

    @cached_property
    def winevent(self) -> DataFrame:
        return xml_record_events(self.raw("winevent_records"))

    @cached_property
    def xml(self) -> DataFrame:
        return xml_record_events(self.raw("xml_records"))
