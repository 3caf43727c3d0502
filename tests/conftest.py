import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from logloom.session import local_session

    s = local_session(4, spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


CALL = "struct<id:string,name:string,arguments:string>"
MESSAGES = f"array<struct<role:string,content:string,turn_idx:int,tool_call_id:string,error:boolean,tool_calls:array<{CALL}>>>"


def message(role, content=None, calls=None, answers=None, error=None):
    return (role, content, None, answers, error, calls)
