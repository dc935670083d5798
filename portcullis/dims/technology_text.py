"""Signs of technologies, one ``category : technology : pattern`` per line, by language.

TypeScript uses the JavaScript text.
"""

TECHNOLOGIES = {
    "python": r'''
logging : loguru : from loguru import
logging : loguru : import loguru
logging : loguru : loguru\.
logging : structlog : import structlog
logging : structlog : structlog\.
logging : python-json-logger : pythonjsonlogger
logging : python-json-logger : JsonFormatter
logging : logging : import logging
logging : logging : logging\.
web_frameworks : fastapi : from fastapi import
web_frameworks : fastapi : FastAPI\(
web_frameworks : fastapi : @app\.
web_frameworks : flask : from flask import
web_frameworks : flask : Flask\(
web_frameworks : flask : @app\.route
web_frameworks : django : from django
web_frameworks : django : django\.
web_frameworks : django : urls\.py
web_frameworks : starlette : from starlette
web_frameworks : starlette : Starlette\(
async : asyncio : import asyncio
async : asyncio : async def
async : asyncio : await 
async : aiohttp : import aiohttp
async : aiohttp : aiohttp\.
async : aiofiles : import aiofiles
async : aiofiles : aiofiles\.
testing : pytest : import pytest
testing : pytest : @pytest\.
testing : pytest : def test_
testing : unittest : import unittest
testing : unittest : unittest\.TestCase
testing : mock : from unittest.mock
testing : mock : @mock\.
database : sqlalchemy : from sqlalchemy
database : sqlalchemy : sqlalchemy\.
database : django-orm : from django.db
database : django-orm : models\.Model
database : pymongo : import pymongo
database : pymongo : pymongo\.
database : redis : import redis
database : redis : redis\.
monitoring : sentry : import sentry_sdk
monitoring : sentry : sentry_sdk\.
monitoring : prometheus : prometheus_client
monitoring : prometheus : prometheus\.
monitoring : datadog : datadog
monitoring : datadog : ddtrace
''',
    "java": r'''
logging : logback : logback\.xml
logging : logback : ch\.qos\.logback
logging : log4j : log4j
logging : log4j : org\.apache\.log4j
logging : slf4j : org\.slf4j
logging : slf4j : import.*slf4j
web_frameworks : spring-boot : @SpringBootApplication
web_frameworks : spring-boot : @RestController
web_frameworks : spring-boot : @RequestMapping
web_frameworks : spring-mvc : @Controller
web_frameworks : spring-mvc : @RequestMapping
web_frameworks : jersey : @Path
web_frameworks : jersey : @GET
web_frameworks : jersey : @POST
web_frameworks : servlet : HttpServlet
web_frameworks : servlet : @WebServlet
testing : junit : @Test
testing : junit : import.*junit
testing : junit : org\.junit
testing : mockito : import.*mockito
testing : mockito : @Mock
testing : testng : import.*testng
testing : testng : @Test
database : hibernate : @Entity
database : hibernate : @Table
database : hibernate : hibernate
database : jpa : @Entity
database : jpa : javax\.persistence
database : jdbc : java\.sql
database : jdbc : DriverManager
monitoring : micrometer : micrometer
monitoring : micrometer : @Timed
monitoring : actuator : spring-boot-actuator
monitoring : actuator : @Endpoint
''',
    "javascript": r'''
logging : winston : require\(["\']winston
logging : winston : import.*winston
logging : winston : winston\.
logging : bunyan : require\(["\']bunyan
logging : bunyan : bunyan\.
logging : pino : require\(["\']pino
logging : pino : pino\(
logging : console : console\.log
logging : console : console\.error
web_frameworks : express : require\(["\']express
web_frameworks : express : express\(
web_frameworks : express : app\.get
web_frameworks : koa : require\(["\']koa
web_frameworks : koa : new Koa
web_frameworks : fastify : require\(["\']fastify
web_frameworks : fastify : fastify\(
web_frameworks : nestjs : @nestjs
web_frameworks : nestjs : @Controller
web_frameworks : nestjs : @Injectable
frontend : react : import.*react
frontend : react : from ["\']react
frontend : react : React\.
frontend : vue : import.*vue
frontend : vue : Vue\.
frontend : vue : @Component
frontend : angular : @angular
frontend : angular : @Component
frontend : angular : @Injectable
testing : jest : describe\(
testing : jest : it\(
testing : jest : test\(
testing : jest : expect\(
testing : mocha : require\(["\']mocha
testing : mocha : describe\(
testing : mocha : it\(
testing : cypress : cy\.
testing : cypress : cypress
monitoring : sentry : @sentry
monitoring : sentry : Sentry\.
monitoring : datadog : dd-trace
monitoring : datadog : datadog
''',
    "csharp": r'''
logging : serilog : using Serilog
logging : serilog : Log\.
logging : serilog : Serilog\.
logging : nlog : using NLog
logging : nlog : NLog\.
logging : ilogger : ILogger<
logging : ilogger : _logger\.Log
web_frameworks : asp.net-core : Microsoft\.AspNetCore
web_frameworks : asp.net-core : \[ApiController\]
web_frameworks : asp.net-core : \[Route
web_frameworks : mvc : Controller
web_frameworks : mvc : ActionResult
web_frameworks : web-api : \[ApiController\]
web_frameworks : web-api : \[HttpGet\]
testing : xunit : using Xunit
testing : xunit : \[Fact\]
testing : xunit : \[Theory\]
testing : nunit : using NUnit
testing : nunit : \[Test\]
testing : mstest : Microsoft\.VisualStudio\.TestTools
testing : mstest : \[TestMethod\]
database : entity-framework : using.*EntityFramework
database : entity-framework : DbContext
database : dapper : using Dapper
database : dapper : Dapper\.
monitoring : application-insights : Microsoft\.ApplicationInsights
monitoring : application-insights : TelemetryClient
''',
}
